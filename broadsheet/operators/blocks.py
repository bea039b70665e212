"""Preparation of detected blocks and suppression of duplicate detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..schemas import NUMBERS, PAGE


def prepare(blocks: DataFrame) -> DataFrame:
    """Numbers as doubles (null if none), area with sides of 1 at least, and the page's key."""
    out = blocks.withColumns({c: geometry.number(c) for c in NUMBERS if c in blocks.columns})
    out = out.withColumns({c: F.col(c).cast("int") for c in ("image_id", "page_width", "page_height") if c in blocks.columns})
    key = F.concat_ws("||", *(F.col(c).cast("string") for c in PAGE))
    return out.withColumns({"area": F.greatest("width", F.lit(1.0)) * F.greatest("height", F.lit(1.0)), "page_key": key})


def _descending(column: str) -> Column:
    return F.coalesce(-F.col(column), F.lit(float("inf"))).alias(f"by_{column}")


def suppress(blocks: DataFrame) -> DataFrame:
    """Keeps, of the blocks of a page and class, in the order of confidence, width, height and `ord`, those that no kept one duplicates.

    One exchange by page and class; the fold over a group, which is part of a page, runs in the JVM. Blocks without page key or class go.
    """
    missing = {*PAGE, "class_name", "confidence", "x1", "y1", "x2", "y2", "width", "height", "ord"} - {*blocks.columns}
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    keys = [*PAGE, "class_name"]
    row = F.struct(_descending("confidence"), _descending("width"), _descending("height"), F.col("ord").alias("by_ord"), F.struct(*blocks.columns).alias("row"))
    some = blocks.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("visited"))
    rows = F.transform("visited", lambda r: r["row"])
    kind = some.select(rows.alias("r")).schema["r"].dataType

    def visit(kept: Column, r: Column) -> Column:
        return F.when(F.exists(kept, lambda k: geometry.duplicates(r, k)), kept).otherwise(F.concat(kept, F.array(r)))

    kept = some.select(F.aggregate(rows, F.array().cast(kind), visit).alias("kept"))
    return kept.select(F.inline("kept"))


def rekey(blocks: DataFrame, pages: DataFrame, newspaper_id: str | Column | None = None) -> DataFrame:
    """Blocks of other runs on these pages: numbered anew by newspaper and image in the order of `ord`, with the pages' attributes, then suppressed.

    pages: their newspaper_id and image_id are those of the blocks. newspaper_id: of the new blocks, a text for one newspaper's blocks or, for those of
    several, an expression that keeps them apart; without one, each newspaper's own.
    """
    attributes = ["page_number", "page_filename", "image_path", "page_width", "page_height"]
    source = ["newspaper_id", "image_id"]
    own = blocks.drop(*attributes, "image_path_in_zip", "block_id").join(pages.select(*source, *attributes), source)
    own = own.withColumn("number", F.row_number().over(Window.partitionBy(*source).orderBy("ord")) - 1)
    if newspaper_id is not None:
        own = own.withColumn("newspaper_id", F.lit(newspaper_id))
    named = own.withColumn("block_id", F.concat_ws("__", "newspaper_id", F.col("image_id").cast("string"), F.col("number").cast("string"))).drop("number")
    return suppress(named.withColumn("image_path_in_zip", F.col("page_filename")))


def crops(blocks: DataFrame) -> DataFrame:
    """(block_id, left, top, right, bottom, too_small): the pixels of a block that OCR gets."""
    box = geometry.crop_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "page_width", "page_height")))
    return blocks.select("block_id", box.alias("box")).select("block_id", "box.*", F.col("box").isNull().alias("too_small"))
