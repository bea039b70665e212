"""Documents and jobs: latest status of each job, stage progress, reuse of an earlier document's detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Progress of each stage, in percent.
STAGES = {
    "uploaded": 0, "queued": 3, "processing": 8, "extract_pages": 12, "load_cached_yolo": 24, "detect_blocks": 24, "candidate_pairs": 42, "ocr_features": 58, "pairwise_features": 68,
    "pairwise_prediction": 78, "clustering": 88, "write_outputs": 96, "completed": 100, "failed": 100,
}


def latest(updates: DataFrame, key: str, order: list[str], merged: list[str] | None = None) -> DataFrame:
    """The last update of each key. merged: columns whose last non-null value counts, as updates name only what they change."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    whole = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = updates.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in merged or []})
    return filled.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")


def with_progress(updates: DataFrame, stage: str = "stage") -> DataFrame:
    """Adds the stage's progress, where the update has none of its own."""
    table = F.create_map(*(x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))))
    known = F.try_element_at(table, F.col(stage))
    return updates.withColumn("progress", F.coalesce(F.col("progress"), known) if "progress" in updates.columns else known)


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(STAGES.items())], "stage string, progress int, place int")


def detection_cache(documents: DataFrame, key: str = "file_sha256", path: str = "path") -> DataFrame:
    """(document, cached): for each document the first other one, by path, with the same content and detections of its own.

    Each content's first and second document are all that is needed, so nothing is joined with itself: the first is the answer for all
    but itself, which gets the second.
    """
    have = documents.filter(F.col("has_blocks") & F.col(key).isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy(path))
    two = have.select(key, path, "document_id", place.alias("place")).filter("place <= 2")
    two = two.groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col("document_id"))).alias("one"), F.max(F.when(F.col("place") == 2, F.col("document_id"))).alias("two"))
    found = documents.filter(F.col(key).isNotNull()).join(two, key)
    return found.select("document_id", F.when(F.col("document_id") != F.col("one"), F.col("one")).otherwise(F.col("two")).alias("cached_document_id")).filter("cached_document_id IS NOT NULL")
