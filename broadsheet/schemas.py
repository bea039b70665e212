"""Schemas and fixed vocabularies of the layout engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Classes of layout blocks.
TEXT_CLASSES = ("Text", "List-item", "Caption", "Footnote")
HEADLINE_CLASSES = ("Section-header", "Title")
#: Classes that are read as text; unlike TEXT_CLASSES they include headlines.
OCR_CLASSES = TEXT_CLASSES + HEADLINE_CLASSES

SAME, ADJACENT, CROSS = "same_column_window", "adjacent_column", "cross_column_headline_continuation"
PAGE = ("newspaper_id", "image_id", "page_filename")

PAGES = T.StructType(
    [
        T.StructField("newspaper_id", T.StringType()),
        T.StructField("image_id", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("page_filename", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("page_width", T.IntegerType()),
        T.StructField("page_height", T.IntegerType()),
    ]
)

#: Columns of a block that hold numbers.
NUMBERS = ("image_id", "page_width", "page_height", "x1", "y1", "x2", "y2", "width", "height", "center_x", "center_y", "confidence")

BLOCKS_CSV = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("newspaper_id",)),
        T.StructField("image_id", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        *(T.StructField(n, T.StringType()) for n in ("page_filename", "image_path", "image_path_in_zip")),
        T.StructField("page_width", T.IntegerType()),
        T.StructField("page_height", T.IntegerType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        *(T.StructField(n, T.DoubleType()) for n in ("confidence", "x1", "y1", "x2", "y2")),
        T.StructField("bbox", T.StringType()),
        *(T.StructField(n, T.DoubleType()) for n in ("width", "height", "center_x", "center_y")),
    ]
)

# Columns of a candidate pair, in their order.
PAIR_COLUMNS = """
pair_id newspaper_id image_id page_number page_filename image_path_in_zip left_block_id right_block_id left_class_name
right_class_name class_pair left_article_id right_article_id label label_reason candidate_sources num_candidate_sources
left_confidence right_confidence min_yolo_confidence mean_yolo_confidence left_article_id_confidence
right_article_id_confidence min_article_id_confidence mean_article_id_confidence left_article_ambiguous
right_article_ambiguous left_x1 left_y1 left_x2 left_y2 right_x1 right_y1 right_x2 right_y2 left_column_id right_column_id
column_delta abs_column_delta column_relation reading_order_delta global_reading_order_delta x_overlap_ratio
y_overlap_ratio horizontal_gap_norm vertical_gap_norm center_dx_norm center_dy_norm abs_center_dx_norm abs_center_dy_norm
center_distance_norm area_ratio width_ratio height_ratio hard_negative
""".split()

# What the pair model was fitted on, in its order.
NUMERIC_FEATURES = """
num_candidate_sources left_confidence right_confidence min_yolo_confidence mean_yolo_confidence left_x1 left_y1 left_x2
left_y2 right_x1 right_y1 right_x2 right_y2 left_column_id right_column_id column_delta abs_column_delta
reading_order_delta global_reading_order_delta x_overlap_ratio y_overlap_ratio horizontal_gap_norm vertical_gap_norm
center_dx_norm center_dy_norm abs_center_dx_norm abs_center_dy_norm center_distance_norm area_ratio width_ratio
height_ratio ocr_cosine_similarity text_similarity entity_overlap shared_keywords
""".split()
SOURCE_FEATURES = "adjacent_column global_reading_order reading_order same_column_window spatial_knn".split()
FEATURE_CLASSES = "Caption List-item Page-footer Page-header Picture Section-header Table Text".split()
#: The classes that each class was seen to be paired with.
FEATURE_PARTNERS = {
    "Caption": "Caption Page-footer Page-header Picture Section-header Text",
    "List-item": "Caption List-item Picture Section-header Text",
    "Page-footer": "Caption Page-footer Page-header Picture Section-header Text",
    "Page-header": "Caption Page-header Picture Section-header Text",
    "Picture": "Caption List-item Page-footer Page-header Picture Section-header Table Text",
    "Section-header": "Caption List-item Page-footer Page-header Picture Section-header Table Text",
    "Table": "Caption Picture Section-header Text",
    "Text": "Caption List-item Page-footer Page-header Picture Section-header Table Text",
}
RELATIONS = "adjacent_column cross_column same_column".split()
FEATURES = (
    NUMERIC_FEATURES
    + [f"source__{s}" for s in SOURCE_FEATURES]
    + [f"{side}_class_name_{c}" for side in ("left", "right") for c in FEATURE_CLASSES]
    + [f"class_pair_{a}__{b}" for a, partners in FEATURE_PARTNERS.items() for b in partners.split()]
    + [f"column_relation_{r}" for r in RELATIONS]
)
