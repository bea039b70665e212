"""Corpus pipeline: documents are filtered, deduplicated by line and by document, cleared of secrets, and packed.

Each stage is one operator of the llm subpackage with its production parameters. It works on all that its predecessor kept; all but the last return
the columns of documents, with n_chars of the text as it has become. Rows with a null id pass through all stages; null texts are kept as
they are by the stages that change texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import common, lines, near, packing, quality, secrets


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers as public

    return public.path(name), public.PATTERN


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives THRESHOLD or more; it learns from labels that are not held out."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), learn=~quality.held_out())
    (score,) = common.fresh_name(docs, "score")
    return quality.scored(docs, model, out=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match earlier ones; documents that lose all their words that way go."""
    left = lines.dedup(docs)
    return _counted(left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_lines", "n_removed"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    found = near.groups(docs.select("doc_id", "text"), near.Rule())
    dropped = found.filter(F.col("component") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _counted(secrets.redact(docs, *_vocabulary("byte_bpe_50k.tiktoken")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it is in which sequence."""
    return packing.pack(docs, *_vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The quality, secret and packing stages are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_stash(before)
    return docs
