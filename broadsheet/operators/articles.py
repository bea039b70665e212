"""Articles and the read views over a run's tables. Each function gives the DataFrame behind one read endpoint.

Arrays are built in an explicit order: pages by their first block, clusters by their smallest member, members by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerce_number
from ..schemas import PAGE


def page_label(image_id: Column) -> Column:
    """page_001 for the first image."""
    return F.format_string("page_%03d", (image_id + 1).cast("int"))


def articles(clusters: DataFrame) -> DataFrame:
    """(newspaper_id, article_id, confidence, detection_ids, page_ids): one article for each cluster of a document."""
    member = F.struct("image_id", "page_filename", "block_id")
    made = clusters.groupBy("newspaper_id", F.col("predicted_cluster_id").alias("article_id")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.avg("confidence").alias("mean"))
    return made.select(
        "newspaper_id",
        "article_id",
        F.coalesce(F.round("mean", 4), F.lit(0.0)).alias("confidence"),
        F.transform("members", lambda m: m["block_id"]).alias("detection_ids"),
        F.array_distinct(F.transform("members", lambda m: page_label(m["image_id"]))).alias("page_ids"),
    )


def detections(blocks: DataFrame) -> DataFrame:
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return blocks.select("newspaper_id", F.col("block_id").alias("detection_id"), page_label(F.col("image_id")).alias("page_id"), F.col("class_name").alias("label"), "confidence", box.alias("bbox"))


def pages_view(pages: DataFrame) -> DataFrame:
    uri = F.concat(F.lit("documents/"), F.col("newspaper_id"), F.lit("/outputs/pages/"), F.col("page_filename"))
    return pages.select("newspaper_id", F.format_string("page_%03d", F.col("page_number").cast("int")).alias("page_id"), "page_number", uri.alias("image_uri"))


def candidate_view(pairs: DataFrame) -> DataFrame:
    """Pairs with everything but their ids in one JSON object."""
    rest = [c for c in pairs.columns if c not in ("pair_id", "left_block_id", "right_block_id")]
    features = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return pairs.select("newspaper_id", "pair_id", F.col("left_block_id").alias("source_detection_id"), F.col("right_block_id").alias("target_detection_id"), features.alias("features"))


def pairwise_view(scored: DataFrame, model_version: str = "pairwise-v1") -> DataFrame:
    audit = {"cluster_validation_status": "string", "cluster_validation_score": "double", "cluster_validation_reason": "string"}
    return scored.select(
        "newspaper_id", "pair_id", (F.col("prediction") == 1).alias("prediction"), F.col("probability_same_article").alias("probability"), F.lit(model_version).alias("model_version"),
        *((F.col(c) if c in scored.columns else F.lit(None)).cast(t).alias(c) for c, t in audit.items()),
    )


def article_detail(found: DataFrame, shown: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles with the detections and pages that they name, nested; of an id in several documents the first document's."""
    first = found.groupBy("article_id").agg(F.min_by(F.struct("newspaper_id", "confidence", "detection_ids", "page_ids"), "newspaper_id").alias("a")).select("article_id", "a.*")
    own = first.select("article_id", "newspaper_id", F.explode("detection_ids").alias("detection_id")).join(shown, ["newspaper_id", "detection_id"])
    own = own.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("detection_id", "page_id", "label", "confidence", "bbox"))).alias("detections"))
    seen = first.select("article_id", "newspaper_id", F.explode("page_ids").alias("page_id")).join(pages_view(pages), ["newspaper_id", "page_id"])
    seen = seen.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "page_number", "image_uri"))).alias("pages"))
    return first.join(own, "article_id", "left").join(seen, "article_id", "left")


def visualization(pages: DataFrame, shown: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their detections and their articles, nested."""
    views = pages_view(pages)
    own = shown.groupBy("newspaper_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("detection_id", "label", "confidence", "bbox"))).alias("detections"))
    on_page = found.select("newspaper_id", F.explode("page_ids").alias("page_id"), "article_id", "confidence", "detection_ids", "page_ids")
    on_page = on_page.groupBy("newspaper_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "confidence", "detection_ids", "page_ids"))).alias("articles"))
    return views.join(own, ["newspaper_id", "page_id"], "left").join(on_page, ["newspaper_id", "page_id"], "left")


def manifest_counts(pages: DataFrame, blocks: DataFrame, scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of a run's counts."""
    counts = [
        pages.agg(F.count(F.lit(1)).alias("pages")), blocks.agg(F.count(F.lit(1)).alias("blocks")),
        scored.agg(F.count(F.lit(1)).alias("candidate_pairs"), F.coalesce(F.sum("prediction"), F.lit(0)).cast("long").alias("predicted_positive_pairs")),
        clusters.agg(F.countDistinct("predicted_cluster_id").alias("clusters")),
    ]
    # Each side is one row of an aggregate without groups; the key makes the join an equi-join.
    out = counts[0].withColumn("one", F.lit(1))
    for other in counts[1:]:
        out = out.join(other.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def metrics(counts: DataFrame) -> DataFrame:
    positive = F.col("predicted_positive_pairs")
    return counts.select("candidate_pairs", positive.alias("positive_pairs"), F.greatest(F.col("candidate_pairs") - positive, F.lit(0)).alias("negative_pairs"), F.col("clusters").alias("articles_found"), F.lit(None).cast("double").alias("processing_time_seconds"))


def coerced(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, coerce_number(column).alias("v")).select(*keep, "v.*")
