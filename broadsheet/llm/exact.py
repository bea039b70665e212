"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

Texts are equal when identical after deletion of the six white-space characters U+0020 and U+0009 to U+000D. The index is
a table of the warehouse with one row per distinct text. A batch is digested, summed up by digest (map-side first, so
that a digest of a third of all rows moves as one row per task), joined with the index by a sort-merge anti-join that
needs no exchange of the index, and its new digests are appended in the same buckets. Rows find the row that stays by
joining the index on the digest; digests with more than a HOT_SHARE-th of the batch's rows, which can be HOT_SHARE at
most, are broadcast, so that no task gets more of a digest than that share.

Defined results: null text counts as empty, and empty and white-space-only texts are one group. Of equal new texts the row
with the most code points stays, then the smallest id (a null id comes last). A text that the index already holds keeps
the row named there. Rows that repeat an id with an equal text are told apart by nothing, so all of them say kept.
An empty batch appends nothing and gives no rows. Of the input's columns only id and text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters whose deletion makes texts equal (fixed values).
WHITE = " \t\n\x0b\x0c\r"
BUCKETS = 64
HOT_SHARE = 256


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest binary, n_points) of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(F.encode(F.translate(whole, WHITE, ""), "utf-8"), 256)).alias("digest"),
        F.length(whole).cast("long").alias("n_points"),
    )


class DigestIndex:
    """The persistent index: a bucketed, sorted table (digest, keep_id)."""

    def __init__(self, spark: SparkSession, name: str, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Rows whose digest the index lacks: sort-merge anti-join, in the index's buckets."""
        return groups.repartition(self.buckets, "digest").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        new = self.missing(groups).select("digest", "keep_id")
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds a batch to the index. One row per row of the batch: id, keep_id, group_size (in the batch), kept, digest."""
    rows = common.stash(digests(df, id_col, text), "digests")
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("null_id"), F.col("id").alias("id")))
    groups = common.stash(rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("first.id").alias("keep_id"), "group_size"), "groups")
    index.append(groups)
    found = index.read().hint("merge").join(groups.select("digest", "group_size").repartition(index.buckets, "digest"), "digest")
    total = rows.count()
    hot = F.broadcast(found.filter(F.col("group_size") * HOT_SHARE > total))
    cold = found.filter(F.col("group_size") * HOT_SHARE <= total)
    joined = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    found = common.stash(joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"), "found")
    common.drop_stash(rows, groups)
    return found


def query(spark: SparkSession, sf_dir: str, index_name: str | None = None) -> DataFrame:
    """op3: exact copies among all documents, through the index of that name, which stays; without a name, through a new one that is dropped."""
    index = DigestIndex(spark, index_name or f"exact_index_{uuid.uuid4().hex}")
    try:
        found = dedup(common.table(spark, sf_dir, "documents"), index)
    finally:
        if not index_name:
            index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS whole, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, arg_min(doc_id, (-length(whole), doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
