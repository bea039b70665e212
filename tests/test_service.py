"""Store, model files, command line, and runs from adapters."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet import __main__ as command
from broadsheet.operators import blocks, scoring
from broadsheet.plans.run import Config, run
from broadsheet.schemas import FEATURES
from broadsheet.sources import images, tables
from broadsheet.sources.store import NotFound, Request, Store
from tests import fakes


def test_store(tmp_path):
    store = Store(str(tmp_path))
    assert store.health() == {"status": "ok"}
    with pytest.raises(ValueError):
        store.upload("x.txt", b"abc")
    done = store.upload("Scan.TIF", b"abc", "library")
    key = done["document_id"]
    assert key.startswith("doc_") and len(key) == 16 and store.document(key) == done and done["file_uri"] == f"documents/{key}/original.tif"
    assert (tmp_path / done["file_uri"]).read_bytes() == b"abc" and done["file_sha256"].startswith("ba7816bf")
    assert store.update_document(key, page_count=3)["page_count"] == 3 and store.document(key)["source_name"] == "library"
    for wrong in ("doc_none", "../jobs", "..", "a/b"):
        with pytest.raises(NotFound):
            store.document(wrong)
    job = store.queue(key, Request(same_column_top_k=5))
    assert (job["status"], job["progress"], job["request"]["same_column_top_k"]) == ("queued", 3, 5) and store.job(job["job_id"]) == job
    with pytest.raises(NotFound):
        store.queue("doc_none")
    ended = store.process(job["job_id"], lambda document, request: {"article_count": request.same_column_top_k})
    assert (ended["status"], ended["progress"], store.document(key)["article_count"], store.document(key)["status"]) == ("completed", 100, 5, "completed")

    def fail(document, request):
        raise RuntimeError("no model")

    failed = store.process(store.queue(key)["job_id"], fail)
    assert (failed["status"], failed["error"], store.document(key)["status"]) == ("failed", "no model", "failed")
    (tmp_path / "documents" / key / "outputs" / "pages").mkdir(parents=True)
    (tmp_path / "documents" / key / "outputs" / "pages" / "p.png").write_bytes(b"png")
    assert store.page_file(key, "p.png") == b"png"
    for wrong in ("../../metadata.json", "q.png", "/etc/passwd", ""):
        with pytest.raises(NotFound):
            store.page_file(key, wrong)
    with pytest.raises(NotFound):
        store.export_file("x.json")


@pytest.mark.parametrize("wrong", [{"strong_pair_threshold": 1.1}, {"clustering_method": "k"}, {"leiden_resolution": 0}, {"yolo_image_size": 0}, {"cross_column_top_k": -1}, {"other": 1}])
def test_request_bounds(wrong):
    with pytest.raises(ValueError):
        Request.of(wrong)


def test_upload_of_many(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.tif", "b.png", "c.pdf"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    store = Store(str(tmp_path / "store"))
    got = {r.path[-5:]: r for r in store.upload_all(spark.read.format("binaryFile").load(str(tmp_path / "in"))).collect()}
    assert got["c.pdf"].error and got["c.pdf"].document_id is None
    assert store.document(got["a.tif"].document_id)["filename"] == "a.tif"


def test_run_from_detector_and_reader(spark, tmp_path):
    (tmp_path / "Scan.tif").write_bytes(b"3")
    pages = images.write_pages(images.explode_pages(spark.read.format("binaryFile").load(str(tmp_path / "Scan.tif")), fakes.frames, str(tmp_path / "pages")))
    assert sorted(p.name for p in (tmp_path / "pages").iterdir()) == [f"Scan_page_00{i}.png" for i in (1, 2, 3)] and pages.count() == 3
    found = images.detect(pages, fakes.detector)
    text = images.block_text(found, fakes.reader)
    done = run(found.join(text.select("block_id", "ocr_text"), "block_id"), Config(sequence=False))
    rows = done.blocks.collect()
    assert len(rows) == 12 and len({r.block_id for r in rows}) == 12
    assert all(r.ocr_text == f"{r.page_filename} at {int(r.y1) - 6}" for r in rows)
    assert done.clusters.count() == 12
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_command_line(spark, tmp_path):
    (tmp_path / "Scan.tif").write_bytes(b"2")
    args = [str(tmp_path / "Scan.tif"), "--output-dir", str(tmp_path / "out"), "--decoder", "tests.fakes:frames", "--detector", "tests.fakes:detector", "--reader", "tests.fakes:reader", "--pairwise-threshold", "0.4", "--cluster-validation-enabled"]
    paths = command.main(args, spark)
    assert spark.read.parquet(paths["block_clusters"]).count() == 8 and spark.read.parquet(paths["block_ocr"]).count() == 8
    assert spark.read.parquet(paths["pair_predictions"]).first().prediction_threshold == 0.4
    assert spark.read.json(str(tmp_path / "out" / "manifest")).first().counts.blocks == 8
    again = [str(tmp_path / "Scan.tif"), "--output-dir", str(tmp_path / "again"), "--decoder", "tests.fakes:frames", "--no-ocr", "--cached-yolo-blocks", paths["blocks_csv"]]
    paths = command.main(again, spark)
    assert spark.read.parquet(paths["block_clusters"]).count() == 8 and "block_ocr" not in paths
    with pytest.raises(SystemExit):
        command.main(args[:3] + ["--decoder", "tests.fakes:frames"], spark)


def test_cached_blocks_of_several_files(spark, tmp_path):
    # The larger file comes second, so its part of the scan is planned first.
    names = [f.name for f in tables.BLOCKS_CSV.fields]

    def line(i):
        row = dict.fromkeys(names, "") | {"newspaper_id": "np", "image_id": 0, "block_id": f"b{i}", "class_name": "Text", "confidence": 0.5, "x1": 10 * i, "x2": 10 * i + 5, "y1": 0, "y2": 5, "width": 5, "height": 5}
        return ",".join(str(row[n]) for n in names)

    (tmp_path / "in").mkdir()
    for part, some in (("part-0", range(2)), ("part-1", range(2, 400))):
        (tmp_path / "in" / f"{part}.csv").write_text("\n".join([",".join(names), *map(line, some)]))
    pages = spark.createDataFrame([("np", 0, 1, "p.png", "p.png", 9000, 100)], tables.PAGES)
    got = blocks.rekey(tables.blocks_csv(spark, str(tmp_path / "in")), pages).select("block_id", "x1").collect()
    assert {r.block_id: r.x1 for r in got} == {f"np__0__{i}": 10.0 * i for i in range(400)}


def test_model_files(spark, tmp_path):
    names = ["class_pair_Title__Text", "left_class_name___missing__", "source__spatial_knn", "x_overlap_ratio", "no_such_feature"]
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.5, -2.0, 2.0], "default_left": [0, 0, 0]}
    model = {"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [tree]}}}}
    for name, value in (("model", model), ("features", names), ("metrics", {"best_threshold": 0.25})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    path = {k: str(tmp_path / f"{k}.json") for k in ("model", "features", "metrics")}
    config = Config(model_path=path["model"], feature_columns_path=path["features"], metrics_path=path["metrics"])
    assert config.cut() == 0.25 and Config(threshold=0.7, metrics_path=path["metrics"]).cut() == 0.7 and Config(metrics_path=str(tmp_path / "none")).cut() == scoring.DEFAULT_THRESHOLD
    pairs = spark.createDataFrame([("p", "Title__Text", None, "a|spatial_knn", 0.5), ("q", "Text__Text", "Text", "", float("nan"))], "pair_id string, class_pair string, left_class_name string, candidate_sources string, x_overlap_ratio double")
    matrix = {r.pair_id: list(r)[1:] for r in scoring.feature_matrix(pairs, names=scoring.read_features(path["features"])).collect()}
    assert matrix == {"p": [1, 1, 1, 0.5, 0], "q": [0, 0, 0, 0.0, 0]}
    got = {r.pair_id: r for r in scoring.score(pairs, config.model(), config.cut()).collect()}
    assert np.isclose(got["p"].probability_same_article, 1 / (1 + np.exp(-2.0))) and (got["p"].prediction, got["q"].prediction) == (1, 0)
    assert scoring.read_features(None) == FEATURES


def test_ocr_program():
    program = (sys.executable, "-c", "import sys; data = sys.stdin.buffer.read(); print(len(data), *sys.argv[1:]); sys.exit(data == b'bad' and bool(print('broken', file=sys.stderr) or 1))")
    reader = images.Tesseract("deu", "3", program, crop=lambda path, box: path.encode()).load()
    assert reader("four", (0, 0, 1, 1))[0].split() == ["4", "stdin", "stdout", "-l", "deu", "--psm", "3"]
    assert reader("bad", (0, 0, 1, 1)) == ("", "broken")


def test_config_of_a_request():
    config = Config.of_request(Request(run_ocr=False, clustering_method="leiden", pairwise_threshold=0.6, adjacent_column_top_k=0), metrics_path="m")
    assert (config.text, config.method, config.cut(), config.top["adjacent_column"], config.metrics_path) == (False, "leiden", 0.6, 0, "m")


def test_image_names(spark):
    df = spark.createDataFrame([("a.TIFF",), ("a.png",), ("a.tif.txt",)], "path string")
    assert [r[0] for r in df.select(tables.is_image("path")).collect()] == [True, True, False]
    assert df.filter(F.col("path").isNull()).count() == 0
