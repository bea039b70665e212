"""Candidate pairs of blocks: a page-keyed self-join with a bound on the vertical gap, a range anti-join against headlines, top-k per block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.geometry import holds
from ..schemas import ADJACENT, CROSS, HEADLINE_CLASSES, PAIR_COLUMNS, SAME, TEXT_CLASSES

# Fixed values.
MOST_GAP = 450.0
TOP = {SAME: 3, ADJACENT: 2, CROSS: 1}
SAME_OVERLAP, SAME_CENTER, NEAR_GAP = 0.30, 0.40, 0.35
LANE_OVERLAP, LANE_CENTER = 0.80, 0.15
HEADLINE_OVERLAP, HEADLINE_CONFIDENCE = 0.30, 0.30
HEADER_TALL, HEADER_LESS_TALL, HEADER_WIDE = 0.018, 0.012, 0.20

_GEOMETRY = ("block_id", "class_name", "x1", "y1", "x2", "y2", "center_x", "center_y", "column_id", "reading_order_rank", "text_width")


def is_boundary() -> Column:
    """A title, or a section header that is tall, or less tall but wide."""
    tall = F.col("height") / F.greatest(F.col("page_height"), F.lit(1.0))
    wide = F.col("width") / F.greatest(F.col("page_width"), F.lit(1.0))
    header = (tall >= HEADER_TALL) | ((tall >= HEADER_LESS_TALL) & (wide >= HEADER_WIDE))
    return holds((F.col("class_name") == "Title") | ((F.col("class_name") == "Section-header") & header))


def boundaries(layout: DataFrame) -> DataFrame:
    """Headlines that no pair of blocks may reach across."""
    return layout.filter(F.col("class_name").isin(*HEADLINE_CLASSES) & holds(F.col("confidence") >= HEADLINE_CONFIDENCE) & is_boundary())


def near_pairs(layout: DataFrame) -> DataFrame:
    """(page_key, a, b, vertical_gap): pairs of a page, a first in reading order, at most MOST_GAP pixels apart vertically."""
    a = layout.select("page_key", F.struct(*_GEOMETRY).alias("a"))
    b = layout.select("page_key", F.struct(*_GEOMETRY).alias("b"))
    distance = geometry.gap(F.col("a.y1"), F.col("a.y2"), F.col("b.y1"), F.col("b.y2"))
    some = a.join(b, "page_key").filter((F.col("a.reading_order_rank") < F.col("b.reading_order_rank")) & (distance <= MOST_GAP))
    return some.withColumn("vertical_gap", distance)


def _apart() -> tuple[Column, Column, Column]:
    """(upper box, lower box, whether the pair can be cut by a headline at all)."""
    first = holds(F.col("a.y1") <= F.col("b.y1"))
    upper, lower = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    plain = ~F.col("a.class_name").isin(*HEADLINE_CLASSES) & ~F.col("b.class_name").isin(*HEADLINE_CLASSES)
    return upper, lower, plain & holds(upper["y2"] < lower["y1"])


def _cuts(h: str, upper: Column, lower: Column) -> Column:
    over = [geometry.overlap_ratio(F.col(f"{h}.x1"), F.col(f"{h}.x2"), box["x1"], box["x2"]) >= HEADLINE_OVERLAP for box in (upper, lower)]
    return (F.col(f"{h}.y1") >= upper["y2"]) & (F.col(f"{h}.y2") <= lower["y1"]) & over[0] & over[1]


def uncut(pairs: DataFrame, layout: DataFrame, blocked: bool = False) -> DataFrame:
    """Pairs without a headline between them that overlaps both; with `blocked`, the others. A hash anti-join by page."""
    upper, lower, can = _apart()
    some = pairs.withColumns({"upper": upper, "lower": lower, "can_be_cut": can})
    lines = boundaries(layout).select(F.col("page_key").alias("h_page"), F.struct("x1", "y1", "x2", "y2").alias("h"))
    cut = (F.col("page_key") == F.col("h_page")) & F.col("can_be_cut") & _cuts("h", F.col("upper"), F.col("lower"))
    return some.join(lines, cut, "left_semi" if blocked else "left_anti").drop("upper", "lower", "can_be_cut")


def buckets(pairs: DataFrame) -> DataFrame:
    """Adds column_delta, center_distance and source, the kind of candidate; pairs of no kind go. All of it is the same from either side."""
    a, b = F.col("a"), F.col("b")
    delta = F.abs(a["column_id"] - b["column_id"])
    overlap = geometry.overlap_ratio(a["x1"], a["x2"], b["x1"], b["x2"])
    center = F.abs(b["center_x"] - a["center_x"])
    width = a["text_width"]
    same = holds(overlap >= SAME_OVERLAP) | holds(center <= width * SAME_CENTER)
    near = holds(geometry.gap(a["x1"], a["x2"], b["x1"], b["x2"]) <= width * NEAR_GAP)
    lane = holds(overlap >= LANE_OVERLAP) & holds(center <= width * LANE_CENTER)
    kinds = [x["class_name"].isin(*HEADLINE_CLASSES) for x in (a, b)], [x["class_name"].isin(*TEXT_CLASSES) for x in (a, b)]
    cross = kinds[0][0] | kinds[0][1] | (kinds[1][0] & kinds[1][1])
    source = F.when((delta == 0) & same, SAME).when((delta == 0) & near, ADJACENT).when((delta == 1) & lane, SAME).when(delta == 1, ADJACENT).when(cross, CROSS)
    distance = F.hypot(b["center_x"] - a["center_x"], b["center_y"] - a["center_y"])
    return pairs.withColumns({"column_delta": delta, "center_distance": distance, "source": source}).filter("source IS NOT NULL")


def top(pairs: DataFrame, limits: dict[str, int] = TOP) -> DataFrame:
    """(page_key, left, right, sources): each block keeps its nearest few of each kind; a pair stays if either side keeps it."""
    limits = {k: max(int(limits.get(k, TOP[k])), 0) for k in TOP}
    ends = F.explode(F.array(F.struct(F.col("a.block_id").alias("anchor"), F.col("b.block_id").alias("other")), F.struct(F.col("b.block_id").alias("anchor"), F.col("a.block_id").alias("other"))))
    both = pairs.select("page_key", F.col("a.block_id").alias("left"), F.col("b.block_id").alias("right"), "source", "vertical_gap", "column_delta", "center_distance", ends.alias("end"))
    order = Window.partitionBy("page_key", "end.anchor", "source").orderBy("vertical_gap", "column_delta", F.asc_nulls_last("center_distance"), "end.other")
    ranked = both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(limits.values()))
    allowed = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in limits.items()))
    kept = ranked.filter(F.col("place") <= allowed)
    return kept.groupBy("page_key", "left", "right").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def _features(a: Column, b: Column) -> dict[str, Column]:
    width, height = a["page_width"].cast("double"), a["page_height"].cast("double")
    wide, tall, diagonal = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0)), F.greatest(F.hypot(width, height), F.lit(1.0))
    dx, dy = b["center_x"] - a["center_x"], b["center_y"] - a["center_y"]
    delta = b["column_id"] - a["column_id"]
    relation = F.when(delta == 0, "same_column").when(F.abs(delta) == 1, "adjacent_column").otherwise("cross_column")
    null, zero = F.lit(None).cast("string"), F.lit(0.0)
    return {
        "pair_id": F.concat_ws("__PAIR__", a["block_id"], b["block_id"]), "newspaper_id": a["newspaper_id"], "image_id": a["image_id"], "page_number": a["page_number"],
        "page_filename": a["page_filename"], "image_path_in_zip": a["page_filename"], "left_block_id": a["block_id"], "right_block_id": b["block_id"],
        "left_class_name": a["class_name"], "right_class_name": b["class_name"], "class_pair": F.concat_ws("__", a["class_name"], b["class_name"]),
        "left_article_id": null, "right_article_id": null, "label": null, "label_reason": F.lit("production_unknown"),
        "candidate_sources": F.array_join("sources", "|"), "num_candidate_sources": F.size("sources"),
        "left_confidence": a["confidence"], "right_confidence": b["confidence"], "min_yolo_confidence": F.least(a["confidence"], b["confidence"]), "mean_yolo_confidence": (a["confidence"] + b["confidence"]) / 2,
        "left_article_id_confidence": zero, "right_article_id_confidence": zero, "min_article_id_confidence": zero, "mean_article_id_confidence": zero,
        "left_article_ambiguous": F.lit(False), "right_article_ambiguous": F.lit(False), "hard_negative": F.lit(False),
        **{f"{side}_{c}": box[c] for side, box in (("left", a), ("right", b)) for c in ("x1", "y1", "x2", "y2", "column_id")},
        "column_delta": delta, "abs_column_delta": F.abs(delta), "column_relation": relation,
        "reading_order_delta": b["reading_order_rank"] - a["reading_order_rank"], "global_reading_order_delta": b["global_reading_rank"] - a["global_reading_rank"],
        "x_overlap_ratio": geometry.overlap_ratio(a["x1"], a["x2"], b["x1"], b["x2"]), "y_overlap_ratio": geometry.overlap_ratio(a["y1"], a["y2"], b["y1"], b["y2"]),
        "horizontal_gap_norm": geometry.gap(a["x1"], a["x2"], b["x1"], b["x2"]) / wide, "vertical_gap_norm": geometry.gap(a["y1"], a["y2"], b["y1"], b["y2"]) / tall,
        "center_dx_norm": dx / wide, "center_dy_norm": dy / tall, "abs_center_dx_norm": F.abs(dx / wide), "abs_center_dy_norm": F.abs(dy / tall), "center_distance_norm": F.hypot(dx, dy) / diagonal,
        **{f"{c}_ratio": geometry.ratio(a[c], b[c]) for c in ("area", "width", "height")},
    }


def describe(kept: DataFrame, layout: DataFrame) -> DataFrame:
    """The columns of PAIR_COLUMNS for pairs (page_key, left, right, sources)."""
    names = [c for c in layout.columns if c not in ("ocr_text", "bbox", "page_key")]
    a = layout.select("page_key", F.col("block_id").alias("left"), F.struct(*names).alias("a"))
    b = layout.select("page_key", F.col("block_id").alias("right"), F.struct(*names).alias("b"))
    both = kept.join(a, ["page_key", "left"]).join(b, ["page_key", "right"])
    features = _features(F.col("a"), F.col("b"))
    return both.select(*(features[c].alias(c) for c in PAIR_COLUMNS))


def pairs(layout: DataFrame, limits: dict[str, int] = TOP) -> DataFrame:
    """Candidate pairs of annotated blocks."""
    found = buckets(uncut(near_pairs(layout), layout))
    return describe(top(found, limits), layout)
