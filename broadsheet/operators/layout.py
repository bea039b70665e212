"""Columns and reading order of pages.

All windows partition by page, so one exchange by page_key serves them; a page's blocks are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import holds
from ..schemas import TEXT_CLASSES

# Shares of the page's width or of the median width.
NARROW, LESS_NARROW, LEAST_CONFIDENCE, LEAST_BLOCKS = 0.55, 0.70, 0.30, 4
MERGE_PAGE, MERGE_MEDIAN, MERGE_MOST = 0.012, 0.08, 0.018
SPLIT_PAGE, SPLIT_GAPS = 0.08, 3


def _page() -> WindowSpec:
    return Window.partitionBy("page_key")


def _by_x() -> WindowSpec:
    return _page().orderBy(F.asc_nulls_last("x1"), F.asc_nulls_last("x2"), "block_id")


def _by_center() -> WindowSpec:
    return _page().orderBy(F.asc_nulls_last("center_x"), "block_id")


def _page_width() -> Column:
    return F.first("page_width").over(_page().orderBy("ord")).cast("double")


def text_block() -> Column:
    """Narrow enough, sure enough and of a text class."""
    return holds(F.col("class_name").isin(*TEXT_CLASSES) & (F.col("width") <= F.col("wide") * NARROW) & (F.col("confidence") >= LEAST_CONFIDENCE))


def with_reference(blocks: DataFrame) -> DataFrame:
    """Adds the page's figures to each block: wide (its width), text_width, column_width, tier, and whether the block is of its reference.

    text_width is the median width of text blocks, or of all blocks without any. Columns come from the text blocks (tier 1), or, if they are fewer than LEAST_BLOCKS,
    from the blocks that are not too wide (tier 2); column_width is their median.
    """
    page = _page()
    some = blocks.withColumn("wide", _page_width()).withColumn("text_block", text_block())
    some = some.withColumn("narrow", holds(F.col("width") <= F.col("wide") * LESS_NARROW))
    length, wide = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest("width", F.lit(1.0))
    some = some.withColumns(
        {
            "tier": F.when(F.count_if("text_block").over(page) >= LEAST_BLOCKS, 1).when(F.count_if("narrow").over(page) > 0, 2).otherwise(0),
            "text_width": F.coalesce(F.median(F.when(F.col("text_block"), wide)).over(page), F.median(wide).over(page)),
            "text_length": F.median(F.when(F.col("text_block"), length)).over(page),
            "narrow_length": F.median(F.when(F.col("narrow"), length)).over(page),
        }
    )
    width = F.when(F.col("tier") == 1, F.col("text_length")).when(F.col("tier") == 2, F.col("narrow_length"))
    own = F.when(F.col("tier") == 1, F.col("text_block")).when(F.col("tier") == 2, F.col("narrow")).otherwise(False)
    return some.withColumns({"column_width": width, "of_reference": own}).drop("text_block", "narrow", "text_length", "narrow_length")


def reference_widths(blocks: DataFrame) -> DataFrame:
    """(page_key, text_width, column_width, tier) of each page."""
    return with_reference(blocks).select("page_key", "text_width", "column_width", "tier").distinct()


def reference_blocks(figured: DataFrame) -> DataFrame:
    """The blocks that columns come from, of blocks with their pages' figures; with the number of different centres."""
    centers = F.size(F.collect_set("center_x").over(_page()))
    return figured.filter("of_reference").withColumn("n_centers", centers)


def islands(reference: DataFrame) -> DataFrame:
    """(page_key, island, x1, x2, n_centers, n_islands): overlapping blocks merged over small gaps."""
    gap = F.least(F.greatest(F.col("wide") * MERGE_PAGE, F.col("column_width") * MERGE_MEDIAN), F.col("wide") * MERGE_MOST)
    before = F.max("x2").over(_by_x().rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("x1") > before + gap), 1).otherwise(0)
    some = reference.withColumn("begins", begins).withColumn("island", F.sum("begins").over(_by_x().rowsBetween(Window.unboundedPreceding, 0)))
    made = some.groupBy("page_key", "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.first("n_centers").alias("n_centers"))
    return made.withColumn("n_islands", F.count(F.lit(1)).over(_page()))


def center_groups(reference: DataFrame) -> DataFrame:
    """(page_key, x1, x2): groups of centres with no gap above the page's threshold, as wide as a median block around them."""
    gaps = reference.withColumn("gap", F.col("center_x") - F.lag("center_x").over(_by_center()))
    usual = F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(_page())
    threshold = F.greatest(F.col("wide") * SPLIT_PAGE, F.coalesce(usual * SPLIT_GAPS, F.col("wide")))
    some = gaps.withColumn("threshold", threshold).withColumn("begins", F.when(F.col("gap") > F.col("threshold"), 1).otherwise(0))
    some = some.withColumn("part", F.sum("begins").over(_by_center().rowsBetween(Window.unboundedPreceding, 0)))
    made = some.groupBy("page_key", "part").agg(F.min("center_x").alias("low"), F.max("center_x").alias("high"), F.first("column_width").alias("column_width"))
    return made.select("page_key", (F.col("low") - F.col("column_width") / 2).alias("x1"), (F.col("high") + F.col("column_width") / 2).alias("x2"))


def columns(blocks: DataFrame, figured: DataFrame | None = None) -> DataFrame:
    """(page_key, column_id, x1, x2, center_x) of each page's columns, numbered from the left; a page without any has one of its width.

    figured: the blocks as with_reference has them, if they are there already.
    """
    figured = with_reference(blocks) if figured is None else figured
    reference = reference_blocks(figured)
    merged = islands(reference)
    split = (F.col("n_islands") <= 1) & (F.col("n_centers") > 1)
    whole = merged.filter(~split).select("page_key", "x1", "x2")
    parts = center_groups(reference).join(merged.filter(split).select("page_key"), "page_key", "left_semi")
    none = figured.filter("tier = 0").groupBy("page_key").agg(F.lit(0.0).alias("x1"), F.first("wide").alias("x2"))
    every = whole.unionByName(parts).unionByName(none)
    number = (F.row_number().over(_page().orderBy("x1", "x2")) - 1).cast("int")
    return every.select("page_key", number.alias("column_id"), "x1", "x2", ((F.col("x1") + F.col("x2")) / 2).alias("center_x"))


def assign(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Adds column_id, the column with the nearest centre, the first of equals. A page's columns come as one small array."""
    centers = found.groupBy("page_key").agg(F.collect_list(F.struct("column_id", "center_x")).alias("centers"))
    nearest = F.array_min(F.transform("centers", lambda c: F.struct(F.abs(F.col("center_x") - c["center_x"]).alias("d"), c["column_id"].alias("column_id"))))
    return blocks.join(centers, "page_key").withColumn("column_id", nearest["column_id"]).drop("centers")


def rank(blocks: DataFrame) -> DataFrame:
    """Adds reading_order_rank (by column) and global_reading_rank, both from 0."""
    down = [F.asc_nulls_last("y1"), F.asc_nulls_last("x1"), "block_id"]
    return blocks.withColumns(
        {
            "reading_order_rank": (F.row_number().over(_page().orderBy("column_id", *down)) - 1).cast("int"),
            "global_reading_rank": (F.row_number().over(_page().orderBy(*down)) - 1).cast("int"),
        }
    )


def annotate(blocks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Blocks with their column, their ranks and the page's text_width. found: the pages' columns, if they are there already."""
    figured = with_reference(blocks)
    placed = assign(figured.drop("wide", "tier", "column_width", "of_reference"), columns(blocks, figured) if found is None else found)
    return rank(placed)
