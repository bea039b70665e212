"""The pipeline on the smallest tables: each stage's rule holds for its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import common, lines, near, quality, secrets
from tests.llm.test_dedup import brute_components, brute_lines, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark, vocabulary):
    docs = common.table(spark, SF, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = docs
        docs = common.stash(stage(spark, docs, SF), name)
        assert docs.columns == columns or name == "packing"
        steps[f"after {name}"] = docs
    rows = {k: sorted(v.collect(), key=lambda r: (r.doc_id, r.piece if "piece" in v.columns else 0)) for k, v in steps.items()}

    model = quality.fit(steps["quality"], common.table(spark, SF, "labels"), learn=~quality.held_out())
    scores = {r.doc_id: r.score for r in quality.scored(steps["quality"], model).collect()}
    assert [r.doc_id for r in rows["after quality"]] == [r.doc_id for r in rows["quality"] if scores[r.doc_id] >= quality.THRESHOLD]

    want = brute_lines([r.text for r in rows["lines"]], lines.SIMILAR)
    kept = [(r.doc_id, t) for r, t in zip(rows["lines"], want) if t == r.text or t.strip()]
    assert [(r.doc_id, r.text) for r in rows["after lines"]] == kept
    assert all(r.n_chars == len(r.text) for r in rows["after lines"])

    sets = [shingles(r.text) for r in rows["near"]]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= near.Rule().percent * (len(sets[a]) + len(sets[b]) - both)

    roots = brute_components(len(sets), linked)
    assert [r.doc_id for r in rows["after near"]] == [r.doc_id for i, r in enumerate(rows["near"]) if roots[i] == i]

    count = secrets.Counter(*vocabulary)
    assert [r.doc_id for r in rows["after secrets"]] == [r.doc_id for r in rows["secrets"]]
    assert all(not secrets.scan_text(r.text, count) for r in rows["after secrets"])
    assert {r.doc_id for r in rows["after packing"]} == {r.doc_id for r in rows["packing"]}


def test_odd_tables(spark):
    docs = common.table(spark, SF, "documents")
    empty = docs.limit(0)
    odd = docs.limit(3).unionByName(docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields)))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).filter("doc_id IS NULL").count() == 1


def test_lines_stage_behind_a_match(spark, monkeypatch):
    # Under "key", the class right behind HOT others is like the first; the last two are like each other alone.
    monkeypatch.setattr(lines, "HOT", 3)
    head, one, two, pair = ([f"{x}{i}" for i in range(9 if x != "s" else 7)] for x in "hpqs")
    queue = [["key", *head], ["key", *one], ["key", *two], ["key", *head, "more"], ["key", *pair], ["own1", "own2", "key", *pair]]
    texts = ["\n".join([*head, *one, *two, *pair, "more"] * 40)] + [" ".join(words) for words in queue]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_lines(texts)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines_stage(spark, docs, SF).collect()} == {i: t for i, t in enumerate(want) if t.strip()}
