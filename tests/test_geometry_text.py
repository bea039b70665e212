"""Expressions against plain Python versions of what they must say."""

import math
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from broadsheet.functions import geometry as G
from broadsheet.functions import text as X


def test_intervals(spark):
    rng = random.Random(1)
    rows = [tuple(float(rng.randint(0, 20)) for _ in range(4)) for _ in range(200)]
    rows = [(min(a, b), max(a, b), min(c, d), max(c, d)) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, "a1 double, a2 double, b1 double, b2 double")
    cols = [F.col(c) for c in df.columns]
    for a1, a2, b1, b2, overlap, gap in df.select("*", G.overlap_ratio(*cols), G.gap(*cols)).collect():
        assert math.isclose(overlap, max(0.0, min(a2, b2) - max(a1, b1)) / max(min(a2 - a1, b2 - b1), 1e-9))
        assert gap == max(b1 - a2, a1 - b2, 0)


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(G.number("v")).collect()] == [1.5, None, None, None, None]


def test_crop(spark):
    df = spark.createDataFrame([(10.5, 0.0, 60.2, 40.0), (100.0, 100.0, 90.0, 101.0)], "x1 double, y1 double, x2 double, y2 double")
    box = G.crop_box(*(F.col(c) for c in df.columns), F.lit(64), F.lit(50))
    found = [r[0] for r in df.select(box).collect()]
    assert tuple(found[0]) == (4, 0, 64, 46) and found[1] is None


TEXTS = [None, "", "   ", "The Mayor of New York City spoke", "éAbc Déjà vu", "state-of-the-art well-known co-op", "the and for with", "A.B. O'Neil & Sons-Co met Big Red Dog Tall Man", "x" * 30 + " keyword", " ".join(f"word{i:02d}" for i in range(20))]


def normal(t):
    return re.sub(r"\s+", " ", t or "").strip().lower()


def tokens(t):
    return {w for w in re.findall(r"[a-z0-9]+", normal(t)) if len(w) >= 3 and w not in X.STOPWORDS}


def test_text_sets(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("t", X.normalize("t"), X.tokens("t"), X.keywords("t"), X.entities("t"), X.cluster_tokens("t")).collect()
    for t, norm, toks, keys, ents, cluster in rows:
        assert norm == normal(t)
        assert set(toks) == tokens(t) and len(set(toks)) == len(toks)
        assert keys == sorted(tokens(t), key=lambda w: (-len(w), w))[:12]
        assert set(ents) == {normal(p) for p in re.findall(X.ENTITY, t or "") if len(p.strip()) >= 3}
        assert set(cluster) == {w for w in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)?", (t or "").lower()) if len(w) >= 3 and w not in X.CLUSTER_STOPWORDS}


def test_jaccard_and_sequence(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], "tide", "diet"), ([], [], "", "x"), (["a"], [], "ab" * 150, "ba" * 150)], "a array<string>, b array<string>, s string, t string")
    rows = df.select(X.jaccard(F.col("a"), F.col("b")), X.sequence_ratio("s", "t"), "s", "t").collect()
    assert [r[0] for r in rows] == [1 / 3, 0.0, 0.0]
    for _, got, s, t in rows:
        assert got == (SequenceMatcher(None, s, t).ratio() if s and t else 0.0)


def test_bigrams(spark):
    df = spark.createDataFrame([("one two three",), ("one",), (None,)], "t string")
    assert [r[0] for r in df.select(X.with_bigrams(X.terms("t"))).collect()] == [["one", "two", "three", "one two", "two three"], ["one"], []]


def test_coerce(spark):
    values = ["", None, "3", "3.0", "3.5", "abc", "inf", "-2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = [tuple(r[0]) for r in df.select(X.coerce_number("v")).collect()]
    assert found == [(None, None, None), (None, None, None), (3, None, None), (3, None, None), (None, 3.5, None), (None, None, "abc"), (None, float("inf"), None), (-2, None, None)]


def test_hashes(spark):
    import hashlib

    row = spark.range(1).select(X.hash_number(F.lit("abc")), X.default_document_id(F.lit("/a/b/Scan 1.tif"))).first()
    assert row[0] == int(hashlib.md5(b"abc").hexdigest()[:12], 16)
    assert row[1] == "Scan 1__" + hashlib.md5(b"/a/b/Scan 1.tif").hexdigest()[:10]
