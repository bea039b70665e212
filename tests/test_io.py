"""Sources, sinks, jobs and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import jobs
from broadsheet.sources import sinks, tables
from broadsheet.streaming import jobs as streams

ARTICLES = "newspaper_id string, article_id string, confidence double, detection_ids array<string>, page_ids array<string>"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("np", "a1", 0.5, ["x", "y"], ["page_001"]), ("np", "a2", 0.25, ["z"], ["page_001", "page_002"])], ARTICLES)
    for form in ("json", "csv", "xml"):
        sinks.export_articles(df, str(tmp_path / form), form)
    rows = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("article_id").collect()
    assert rows[0].detection_ids == "x|y" and rows[1].page_ids == "page_001|page_002"
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    xml = spark.read.format("xml").option("rowTag", "article").load(str(tmp_path / "xml"))
    assert {r._id for r in xml.collect()} == {"a1", "a2"}
    with pytest.raises(ValueError):
        sinks.export_articles(df, "x", "pdf")


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("np", 0, 1, "p.png", "p.png", 10, 20)], tables.PAGES)
    paths = sinks.write_tables({"pages": df}, str(tmp_path))
    assert tables.pages_csv(spark, paths["pages_csv"]).collect() == df.collect()
    with pytest.raises(ValueError):
        sinks.write_tables({"other": df}, str(tmp_path))


def test_manifest_and_payload(spark):
    counts = spark.createDataFrame([(1, 2)], "pages long, blocks long")
    row = sinks.manifest(counts, {"threshold": 0.5}, {}).first()
    assert row.counts.blocks == 2 and row.config == {"threshold": "0.5"} and row.created_at.endswith("Z")
    some = spark.createDataFrame([("np", "b1"), ("np", "b2"), ("nq", "b3")], "newspaper_id string, block_id string")
    got = {r.newspaper_id: json.loads(r.payload) for r in sinks.payload({"blocks": some, "pages": some.limit(0)}).collect()}
    assert {x["block_id"] for x in got["np"]["blocks"]} == {"b1", "b2"} and len(got) == 2


def test_metadata_and_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"document_id": "doc_1", "file_sha256": "s"}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r.document_id for r in tables.metadata(spark, str(tmp_path / "*.json")).collect()] == ["doc_1"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.TIF").write_bytes(b"abc")
    (tmp_path / "up" / "x.txt").write_bytes(b"abc")
    got = {r.path[-3:]: r for r in tables.uploads(spark, str(tmp_path / "up")).collect()}
    assert got["TIF"].accepted and not got["txt"].accepted and got["TIF"].file_sha256 == got["txt"].file_sha256


def test_latest_and_progress(spark):
    df = spark.createDataFrame([("j", 1, "queued", None), ("j", 2, None, 50), ("k", 1, "completed", None)], "job string, n int, stage string, progress int")
    got = {r.job: r for r in jobs.with_progress(jobs.latest(df, "job", ["n"], ["stage"])).collect()}
    assert (got["j"].stage, got["j"].progress) == ("queued", 50) and got["k"].progress == 100


def test_detection_cache(spark):
    rows = [("d1", "p1", "s", False), ("d2", "p2", "s", True), ("d3", "p3", "s", True), ("d4", "p4", "t", True), ("d5", "p5", None, True)]
    df = spark.createDataFrame(rows, "document_id string, path string, file_sha256 string, has_blocks boolean")
    assert {(r[0], r[1]) for r in jobs.detection_cache(df).collect()} == {("d1", "d2"), ("d2", "d3"), ("d3", "d2")}


def test_streams(spark, tmp_path):
    schema = "job string, n int, stage string"
    for k, rows in enumerate(([("j", 1, "queued"), ("k", 1, "queued")], [("j", 2, "completed")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.latest_status(source, str(tmp_path / "out"), str(tmp_path / "check"), "job", ["n"]).awaitTermination(60)
        got = {r.job: r.stage for r in spark.read.schema(schema).parquet(str(tmp_path / f"out/{k}")).collect()}
        assert got == ({"j": "queued", "k": "queued"}, {"j": "completed", "k": "queued"})[k]


def test_landing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    query = streams.landing(spark, str(tmp_path / "in"), spark.range(1).schema, lambda b: b.agg(F.count("id").alias("n")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/batch=0")).first().n == 3
