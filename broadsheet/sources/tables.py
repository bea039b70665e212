"""Readers of a run's files, with explicit schemas, and the blocks that the driver's documents table stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BLOCKS_CSV, PAGES


def pages_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).csv(path, header=True)


def blocks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an earlier run, by the names of their columns; `ord` in the order of the files and their lines: the file, where the split of it begins, and a number that grows inside of a split."""
    raw = spark.read.csv(path, header=True)
    some = raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in BLOCKS_CSV.fields), "_metadata")
    return some.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))).drop("_metadata")


def strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=True)


def metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """Document metadata, one JSON object a file; files that cannot be read are left out."""
    fields = "document_id string, filename string, file_size_bytes long, file_sha256 string, status string, page_count int, article_count int, created_at string, updated_at string, _broken string"
    some = spark.read.schema(fields).json(pattern, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").withColumn("path", F.input_file_name())
    return some.filter(F.col("_broken").isNull() & F.col("document_id").isNotNull()).drop("_broken")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, file_size_bytes, file_sha256, accepted) of files in a landing folder; TIFF and PNG are accepted.

    The id is of the path, so reading again gives the same; `store.Store.upload_all` makes documents with ids of their own.
    """
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return files.select("path", F.concat(F.lit("doc_"), F.substring(F.md5("path"), 1, 12)).alias("document_id"), F.col("length").alias("file_size_bytes"), sha.alias("file_sha256"), is_image("path").alias("accepted"))


def is_image(path: str) -> Column:
    """Whether a file's name ends as those of scans do."""
    return F.lower(path).rlike(r"\.(tif|tiff|png)$")


#: One document is one block: 36 places a page, of which 32 are a grid of 4 columns and 8 rows and 4 detect the first ones again.
BLOCKS_SQL = """
WITH b0 AS (SELECT doc_id AS i, text, doc_id DIV 36 AS pg, doc_id % 36 AS slot FROM {documents}),
 b1 AS (SELECT *, CASE WHEN slot >= 32 THEN slot - 32 ELSE slot END AS base FROM b0),
 b2 AS (SELECT *, base % 4 AS c, base DIV 4 AS r FROM b1),
 b3 AS (SELECT *, (pg * 7 + base * 3 + r) % 10 AS k, pg * 36 + base AS u FROM b2),
 b4 AS (SELECT i, text, pg, slot, k,
   CASE k WHEN 0 THEN 'Section-header' WHEN 1 THEN 'Title' WHEN 2 THEN 'Picture' WHEN 3 THEN 'Caption' WHEN 4 THEN 'List-item' WHEN 5 THEN 'Page-header' ELSE 'Text' END AS class_name,
   (16 + i * 61 % 48) / 64 AS confidence,
   CAST(40 + c * 480 + u * 37 % 23 + CASE WHEN slot >= 32 THEN 3 ELSE 0 END AS DOUBLE) AS x1,
   CAST(60 + r * 280 + u * 29 % 41 AS DOUBLE) AS y1,
   CAST(380 + u * 53 % 61 AS DOUBLE) AS width,
   CAST(CASE WHEN k IN (0, 1) THEN 30 + u * 17 % 31 ELSE 120 + u * 31 % 110 END AS DOUBLE) AS height FROM b3)
SELECT concat('np_', CAST(pg DIV 5 AS STRING)) AS newspaper_id, CAST(pg % 5 AS INT) AS image_id, CAST(pg % 5 + 1 AS INT) AS page_number,
 concat('np_', CAST(pg DIV 5 AS STRING), '_page_00', CAST(pg % 5 + 1 AS STRING), '.png') AS page_filename,
 concat('np_', CAST(pg DIV 5 AS STRING), '__', CAST(pg % 5 AS STRING), '__', CAST(slot AS STRING)) AS block_id,
 CAST(2000 AS INT) AS page_width, CAST(2400 AS INT) AS page_height, CAST(k AS INT) AS class_id, class_name, confidence, x1, y1, x1 + width AS x2, y1 + height AS y2,
 width, height, x1 + width / 2 AS center_x, y1 + height / 2 AS center_y, i AS ord, text AS ocr_text FROM b4
"""


def derived_blocks(documents: DataFrame) -> DataFrame:
    """Blocks made from documents (doc_id, text) by whole-number arithmetic."""
    made = documents.sparkSession.sql(BLOCKS_SQL.format(documents="{documents}"), documents=documents.select("doc_id", "text"))
    return made.withColumns({"image_path": F.col("page_filename"), "image_path_in_zip": F.col("page_filename"), "bbox": F.array("x1", "y1", "x2", "y2")})


def pages_of(blocks: DataFrame) -> DataFrame:
    """The pages that blocks lie on."""
    return blocks.select("newspaper_id", "image_id", "page_number", "page_filename", "image_path", "page_width", "page_height").distinct()
