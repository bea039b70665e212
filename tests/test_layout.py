"""Blocks, columns, candidates and clusters on random pages, against plain Python models of the rules."""

import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import blocks as B
from broadsheet.operators import candidates as C
from broadsheet.operators import clustering as K
from broadsheet.operators import layout as L
from broadsheet.plans import registry
from broadsheet.plans.run import Config, run
from broadsheet.sources import tables

CLASSES = ["Text", "Text", "Text", "List-item", "Caption", "Section-header", "Title", "Picture", "Page-header"]
SCHEMA = "newspaper_id string, image_id int, page_number int, page_filename string, image_path string, page_width int, page_height int, block_id string, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, width double, height double, center_x double, center_y double, ord long, ocr_text string"


def page(rng, number, n, wide=False):
    rows = []
    for i in range(n):
        x1 = rng.choice([40, 520, 1000, 1480]) + rng.randint(0, 30)
        width = rng.randint(1500, 1900) if wide else rng.choice([rng.randint(300, 440), rng.randint(300, 440), rng.randint(900, 1300)])
        y1, height = rng.randint(40, 2200), rng.choice([30, 45, 60, 120, 200])
        rows.append(("np", number, number + 1, f"p{number}.png", f"p{number}.png", 2000, 2400, f"np__{number}__{i}", 0, rng.choice(CLASSES), rng.randint(20, 64) / 64, float(x1), float(y1), float(x1 + width), float(y1 + height), float(width), float(height), x1 + width / 2, y1 + height / 2, number * 1000 + i, rng.choice(["alpha beta gamma", "beta gamma delta", "", None])))
        if rng.random() < 0.15:
            r = list(rows[-1])
            r[7] += "b"
            r[11], r[13], r[17] = r[11] + 3, r[13] + 3, r[17] + 3
            r[19] = number * 1000 + 500 + i
            rows.append(tuple(r))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(5)
    rows = [r for k, (n, w) in enumerate([(14, False), (25, False), (3, False), (5, True), (1, False), (18, False)]) for r in page(rng, k, n, w)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def as_dicts(rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def overlap(a1, a2, b1, b2):
    return max(0.0, min(a2, b2) - max(a1, b1)) / max(min(a2 - a1, b2 - b1), 1e-9)


def gap(a1, a2, b1, b2):
    return max(b1 - a2, a1 - b2, 0.0)


def duplicate(a, b):
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return False
    own, other = (x["width"] * x["height"] for x in (a, b))
    return w * h / (own + other - w * h) >= 0.85 or w * h / own >= 0.95 or w * h / other >= 0.95


def model_nms(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["confidence"], -r["width"], -r["height"], r["ord"])):
        if not any(k["image_id"] == r["image_id"] and k["class_name"] == r["class_name"] and duplicate(r, k) for k in kept):
            kept.append(r)
    return kept


def model_columns(rows):
    width = rows[0]["page_width"]
    ref = [r for r in rows if r["class_name"] in C.TEXT_CLASSES and r["width"] <= width * 0.55 and r["confidence"] >= 0.30]
    if len(ref) < 4:
        ref = [r for r in rows if r["width"] <= width * 0.70]
    if not ref:
        return [(0.0, float(width))]
    usual = median(max(r["x2"] - r["x1"], 1.0) for r in ref)
    merge = min(max(width * 0.012, usual * 0.08), width * 0.018)
    out = []
    for a, b in sorted((r["x1"], r["x2"]) for r in ref):
        if out and a <= out[-1][1] + merge:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    centers = sorted(r["center_x"] for r in ref)
    if len(out) == 1 and len(set(centers)) > 1:
        gaps = [b - a for a, b in zip(centers, centers[1:])]
        most = max(width * 0.08, 3 * median(g for g in gaps if g > 0))
        groups = [[centers[0]]]
        for c, g in zip(centers[1:], gaps):
            groups.append([c]) if g > most else groups[-1].append(c)
        out = [[min(g) - usual / 2, max(g) + usual / 2] for g in groups]
    return [tuple(x) for x in sorted(out)]


def test_suppress(found):
    rows, df = found
    got = {r.block_id for r in B.suppress(B.prepare(df)).select("block_id").collect()}
    assert got == {r["block_id"] for r in model_nms(as_dicts(rows))}


def test_suppress_chain_and_missing(spark):
    base = dict(zip([x.split()[0] for x in SCHEMA.split(", ")], page(random.Random(1), 0, 1)[0]))
    rows = []
    for i, (x, conf, name) in enumerate([(0, 0.9, "Text"), (60, 0.8, "Text"), (120, 0.7, "Text"), (0, 0.9, None)]):
        rows.append({**base, "block_id": f"b{i}", "x1": float(x), "x2": x + 1000.0, "width": 1000.0, "y1": 0.0, "y2": 100.0, "height": 100.0, "class_name": name, "confidence": conf, "ord": i})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert {r.block_id for r in B.suppress(df).collect()} == {"b0", "b2"}
    assert B.suppress(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.suppress(df.drop("ord"))


def test_columns_and_ranks(found):
    rows, df = found
    kept = model_nms(as_dicts(rows))
    placed = {r.block_id: r for r in L.annotate(B.suppress(B.prepare(df))).collect()}
    by_page = defaultdict(list)
    for r in kept:
        by_page[r["image_id"]].append(r)
    found_columns = defaultdict(list)
    for r in L.columns(B.suppress(B.prepare(df))).collect():
        found_columns[r.page_key].append((r.column_id, r.x1, r.x2))
    for number, own in by_page.items():
        columns = model_columns(own)
        got = sorted(found_columns[f"np||{number}||p{number}.png"])
        assert [c for c, _, _ in got] == list(range(len(columns)))
        assert all(math.isclose(a, x) and math.isclose(b, y) for (_, a, b), (x, y) in zip(got, columns))
        centers = [(a + b) / 2 for a, b in columns]
        for r in own:
            r["column_id"] = min(range(len(centers)), key=lambda k: (abs(r["center_x"] - centers[k]), k))
            assert placed[r["block_id"]].column_id == r["column_id"]
        for name, key in (("reading_order_rank", lambda r: (r["column_id"], r["y1"], r["x1"], r["block_id"])), ("global_reading_rank", lambda r: (r["y1"], r["x1"], r["block_id"]))):
            assert [placed[r["block_id"]][name] for r in sorted(own, key=key)] == list(range(len(own)))


def model_pairs(own):
    """Sources of the pairs of a page's annotated blocks."""
    wide, tall = own[0].page_width, own[0].page_height
    text = [max(b.width, 1.0) for b in own if b.class_name in C.TEXT_CLASSES and b.width <= wide * 0.55 and b.confidence >= 0.30]
    usual = median(text or [max(b.width, 1.0) for b in own])
    lines = [b for b in own if b.confidence >= 0.30 and (b.class_name == "Title" or b.class_name == "Section-header" and (b.height / tall >= 0.018 or b.height / tall >= 0.012 and b.width / wide >= 0.20))]
    kept = defaultdict(set)
    for a in own:
        options = defaultdict(list)
        for b in own:
            distance = gap(a.y1, a.y2, b.y1, b.y2)
            if a is b or distance > 450:
                continue
            up, down = (a, b) if a.y1 <= b.y1 else (b, a)
            heads = {"Title", "Section-header"}
            if not {a.class_name, b.class_name} & heads and up.y2 < down.y1 and any(h.y1 >= up.y2 and h.y2 <= down.y1 and min(overlap(h.x1, h.x2, up.x1, up.x2), overlap(h.x1, h.x2, down.x1, down.x2)) >= 0.30 for h in lines):
                continue
            delta, over, center = abs(a.column_id - b.column_id), overlap(a.x1, a.x2, b.x1, b.x2), abs(a.center_x - b.center_x)
            far = {a.class_name, b.class_name} & heads or {a.class_name, b.class_name} <= set(C.TEXT_CLASSES)
            if delta == 0 and (over >= 0.30 or center <= usual * 0.40) or delta == 1 and over >= 0.80 and center <= usual * 0.15:
                kind = C.SAME
            elif delta == 0 and gap(a.x1, a.x2, b.x1, b.x2) <= usual * 0.35 or delta == 1:
                kind = C.ADJACENT
            elif far:
                kind = C.CROSS
            else:
                continue
            options[kind].append((distance, delta, math.hypot(b.center_x - a.center_x, b.center_y - a.center_y), b.block_id, b))
        for kind, some in options.items():
            for *_, b in sorted(some, key=lambda x: x[:4])[: C.TOP[kind]]:
                left, right = sorted((a, b), key=lambda x: x.reading_order_rank)
                kept[left.block_id, right.block_id].add(kind)
    return kept


def test_candidates(found):
    _, df = found
    placed = L.annotate(B.suppress(B.prepare(df))).persist()
    by_page = defaultdict(list)
    for r in placed.collect():
        by_page[r.image_id].append(r)
    want = {k: "|".join(sorted(v)) for own in by_page.values() for k, v in model_pairs(own).items()}
    got = {(r.left_block_id, r.right_block_id): r.candidate_sources for r in C.pairs(placed).collect()}
    assert got == want
    none = C.pairs(placed, {C.SAME: 0, C.ADJACENT: -1, C.CROSS: 0})
    assert none.count() == 0 and none.columns == C.PAIR_COLUMNS


def test_shuffled_input_gives_the_same(found, spark):
    rows, df = found
    mixed = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA)
    one, two = (sorted(map(str, run(x, Config(text=False)).articles().collect())) for x in (df, mixed))
    assert one == two and one


def test_run_with_text_and_validation(found):
    _, df = found
    done = run(df, Config(validate=True, sequence=True))
    statuses = {r.cluster_validation_status for r in done.scored.select("cluster_validation_status").collect()}
    assert statuses <= {"strong_accept", "outside_medium_band", "already_connected", "validated_append_cluster_accept", "rejected_not_singleton_to_cluster", "validated_accept", "validated_reject", "not_evaluated"}
    assert done.clusters.count() == done.blocks.count()
    counts = done.counts().first()
    assert counts.blocks == done.blocks.count() and counts.pages == 6


def test_run_scores_texts(found, monkeypatch):
    """The audit's pairs have their text features."""
    _, df = found
    monkeypatch.setattr(registry, "_detected", lambda spark, sf_dir: df.withColumn("bbox", F.lit(None)))
    reasons = [r.cluster_validation_reason for r in registry.queries()["cluster_audit"](df.sparkSession, "").collect()]
    assert any("text_similarity>=0.2=+0.02" in r for r in reasons)


def test_empty_run(found):
    _, df = found
    done = run(df.limit(0), Config())
    assert done.articles().count() == 0 and "prediction_threshold" in done.scored.columns
    assert done.counts().first().clusters == 0


def test_rekey(found):
    _, df = found
    pages = tables.pages_of(df).filter("image_id < 2")
    got = B.rekey(df, pages, "new").collect()
    assert got and {r.image_id for r in got} == {0, 1} and all(r.block_id.startswith(f"new__{r.image_id}__") for r in got)


def test_rekey_of_several_newspapers(spark):
    rng = random.Random(9)
    rows = [list(r) for name in ("n1", "n2") for k in (0, 1) for r in page(rng, k, 12) if not r[7].endswith("b")]
    for i, r in enumerate(rows):
        r[0] = "n1" if i < len(rows) // 2 else "n2"
        r[3] = r[4] = f"{r[0]}_{r[3]}"
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    new = F.concat(F.lit("new_"), "newspaper_id")
    both = B.rekey(df, tables.pages_of(df), new)
    ids = [r.block_id for r in both.collect()]
    alone = [r.block_id for n in ("n1", "n2") for r in B.rekey(df.filter(F.col("newspaper_id") == n), tables.pages_of(df), f"new_{n}").collect()]
    assert sorted(ids) == sorted(alone) and len({*ids}) == len(ids) and {i.split("__")[0] for i in ids} == {"new_n1", "new_n2"}


def test_rekey_query(spark):
    import duckdb

    name = "cached_blocks_rekey"

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(registry.oracle_sql()[name]).fetchall())
    got = sorted(map(tuple, registry.queries()[name](spark, sf).collect()))
    assert got == want and len({r[0].split("__")[0] for r in got}) == 2


# Clusters.


def scored(spark, edges):
    rows = [(f"{a}__PAIR__{b}", "np", 0, "p.png", a, b, p, int(p >= 0.5)) for a, b, p in edges]
    return spark.createDataFrame(rows, "pair_id string, newspaper_id string, image_id int, page_filename string, left_block_id string, right_block_id string, probability_same_article double, prediction int")


def vertices(spark, ids):
    return spark.createDataFrame([("np", 0, "p.png", i) for i in ids], "newspaper_id string, image_id int, page_filename string, block_id string")


def test_union_find_counts_unknown_blocks(spark):
    got = K.union_find(vertices(spark, "abcde"), scored(spark, [("a", "b", 0.9), ("b", "zz", 0.9), ("c", "d", 0.1)])).collect()
    sizes = {r.block_id: (r.predicted_cluster_id, r.predicted_cluster_size) for r in got}
    assert sizes["a"] == sizes["zz"] == (K.cluster_id(["a", "b", "zz"]), 3)
    assert [sizes[x][1] for x in "cde"] == [1, 1, 1]


def pair(left="a", right="b", p=0.9, **more):
    base = {"left_block_id": left, "right_block_id": right, "pair_id": f"{left}__{right}", "probability_same_article": p, "candidate_sources": "same_column_window", "column_relation": "same_column", "class_pair": "Text__Text", "x_overlap_ratio": 0.9, "text_similarity": 0.1, "vertical_gap_norm": 0.01, "reading_order_delta": 1, "left_class_name": "Text", "right_class_name": "Text"}
    return base | more


@pytest.mark.parametrize(
    "change, accepted",
    [({}, True), ({"p": 0.84}, False), ({"candidate_sources": "adjacent_column", "column_relation": "adjacent_column"}, False), ({"x_overlap_ratio": 0.79}, False), ({"vertical_gap_norm": 0.021}, False), ({"reading_order_delta": 4}, False), ({"reading_order_delta": 0}, False)],
)
def test_append_rules(change, accepted):
    assert K.judge_append(pair(**change), ["x"] * 2, ["y"] * 3, 0.9)[0] is accepted


@pytest.mark.parametrize("small, large, accepted", [(10, 12, True), (11, 12, False), (2, 3, True), (2, 2, False)])
def test_append_sizes(small, large, accepted):
    assert K.judge_append(pair(), ["x"] * small, ["y"] * large, 0.9)[0] is accepted


def test_block_rules():
    words = {"a": {"mayor", "budget", "vote"}, "b": {"mayor", "budget"}, "c": {"vote"}}
    accepted, score, reason = K.judge_block(pair(), "a", ["b", "c"], words, 0.9)
    assert accepted and math.isclose(score, 0.9 + 0.02 + 0.04 + 0.08) and "cluster_ocr_overlap_3=+0.08" in reason and "shared_tokens=budget,mayor,vote" in reason
    accepted, score, reason = K.judge_block(pair(), "a", ["b", "c"], {}, 0.9)
    assert not accepted and "cluster_ocr_unavailable" in reason and math.isclose(score, 0.96)
    assert math.isclose(K.judge_block(pair(), "a", ["b", "c"], {"a": set(), "b": set(), "c": set()}, 0.9)[1], 0.92)
    assert not K.judge_block(pair(p=0.79), "a", ["b", "c"], words, 0.5)[0]


def test_leiden_on_two_cliques():
    edges = {(a, b): 1.0 for g in (range(5), range(5, 10)) for a in g for b in g if a < b} | {(4, 5): 0.1}
    got = K.leiden_partition(10, edges)
    assert len(set(got[:5])) == 1 and len(set(got[5:])) == 1 and got[0] != got[5]
    assert K.modularity(edges, got, 1.0) > K.modularity(edges, list(range(10)), 1.0)


def test_leiden_communities_are_connected():
    rng = random.Random(3)
    edges = {(a, b): rng.random() for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08}
    got = K.leiden_partition(40, edges)
    for c in set(got):
        own = [i for i in range(40) if got[i] == c]
        seen, todo = {own[0]}, [own[0]]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q in own and q not in seen:
                        seen.add(q)
                        todo.append(q)
        assert seen == set(own)
    assert K.modularity(edges, got, 1.0) >= K.modularity(edges, list(range(40)), 1.0)


def test_unknown_method(found):
    _, df = found
    with pytest.raises(ValueError):
        run(df, Config(text=False, method="other"))


def test_features_of_odd_values(spark):
    from broadsheet.operators import scoring

    df = spark.createDataFrame([("p", float("inf"), "global_reading_order|x", "Title")], "pair_id string, x_overlap_ratio double, candidate_sources string, left_class_name string")
    row = scoring.feature_matrix(df).first()
    assert row.x_overlap_ratio == 0.0 and row["source__reading_order"] == 1 and row["source__global_reading_order"] == 1 and row["left_class_name_Text"] == 0
    assert len(row) == 110


def test_trees():
    import numpy as np

    from broadsheet.operators.scoring import Trees
    from broadsheet.schemas import FEATURES

    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.5, -2.0, 2.0], "default_left": [0, 0, 0]}
    model = {"learner": {"feature_names": FEATURES, "learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [tree]}}}}
    x = np.zeros((2, len(FEATURES)))
    x[1, 0] = 2
    assert np.allclose(Trees(model)(x), [1 / (1 + math.exp(2)), 1 / (1 + math.exp(-2))])


def test_adapters(spark, tmp_path):
    from broadsheet.sources import images

    (tmp_path / "Scan.tif").write_bytes(b"2")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    pages = images.explode_pages(files, lambda raw: [(100, 200, b"png")] * int(raw), "out").drop("content")
    assert [r.page_filename for r in pages.orderBy("image_id").collect()] == ["Scan_page_001.png", "Scan_page_002.png"]
    blocks = images.detect(pages, lambda: lambda path: [(7, None, 0.9, 10.0, 10.0, 60.0, 40.0), (1, "Text", 0.1, 0.0, 0.0, 1.0, 1.0), (1, "Text", 0.5, 50.0, 50.0, 50.5, 50.5), (2, "Text", 0.8, 0.0, 90.0, 100.0, 150.0)])
    assert {r.class_name for r in blocks.collect()} == {"7", "Text"}
    texts = images.block_text(blocks, lambda: lambda path, box: (f" {box[2] - box[0]}  wide ", ""))
    by = {(r.class_name, r.ocr_error): r.ocr_text for r in texts.collect()}
    assert by["7", "non_text"] == "" and by["Text", ""] == "100 wide"
    assert {r.ocr_error for r in images.block_text(blocks).collect()} == {"non_text", "ocr_disabled"}
