"""Quality and toxicity: learning on small made-up tables, held-out rows, odd rows."""

import random

import numpy as np
import pytest

from broadsheet.llm import quality, toxicity

WORDS = "harbour council meadow letter garden window river market evening teacher story paper morning travel bridge engine winter supper cousin valley".split()
BAD = ["grobnik", "zaltrash", "wumpoid"]


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n)).capitalize() + "."


def junk(rng):
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in sentence(rng, 30).split()), lambda: " | ".join(sentence(rng, 30).split()), lambda: "spam " * 40])()


@pytest.fixture(scope="module")
def quality_rows(spark, docs):
    rng = random.Random(3)
    rows = [(sentence(rng, rng.randint(5, 80)), 1) if rng.random() < 0.7 else (junk(rng), 0) for _ in range(500)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(3, None), (None, 1)], "doc_id long, quality int")
    return rows, docs([t for t, _ in rows]), labels


def test_quality(quality_rows):
    rows, df, labels = quality_rows
    model = quality.fit(df, labels, learn=~quality.held_out())
    got = {r.doc_id: r.score for r in quality.scored(df, model).withColumn("held", quality.held_out()).filter("held").collect()}
    assert len(got) > 50 and all(0 <= s <= 1 for s in got.values())
    right = [(s >= 0.3) == (rows[i][1] == 1) for i, s in got.items()]
    assert np.mean(right) > 0.95


def test_quality_odd_rows(docs, quality_rows, spark):
    rows, df, labels = quality_rows
    model = quality.fit(df, labels)
    odd = quality.scored(docs([None, "", "  \n", "x" * 200_000, "a", "a"], [None, 1, 2, 3, 4, 4]), model).collect()
    assert len(odd) == 6 and all(0 <= r.score <= 1 for r in odd) and abs(odd[0].score - odd[1].score) < 1e-9
    assert quality.scored(docs([]), model).count() == 0
    with pytest.raises(ValueError):
        quality.scored(df, model, out="word")
    for some, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert {r.score for r in quality.scored(docs(["a", None]), quality.fit(df, some)).collect()} == {want}


def test_bounded_sample(quality_rows):
    _, _, labels = quality_rows
    from pyspark.sql import functions as F

    n = quality.sample(labels, "quality", F.lit(True), "doc_id", 100).count()
    assert 50 < n < 160


def test_isotonic():
    knots, values = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def brute_kernel(a, b):
    """Gap-weighted subsequence kernel by listing subsequences."""
    from itertools import combinations

    def features(w):
        out = {}
        for places in combinations(range(len(w)), toxicity.ORDER):
            u = tuple(toxicity._letter(w[i]) for i in places)
            out[u] = out.get(u, 0.0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_against_listing():
    some = ["^idiot$", "^idixot$", "^moron$", "^banana$", "^aaaaaa$", "^wörter$"]
    got = toxicity.Landmarks(some).kernel(some)
    want = [[brute_kernel(a, b) for b in some] for a in some]
    assert np.allclose(got, want, atol=1e-5)


def test_tokens_and_windows():
    assert "idiot" in toxicity.tokens("you i d i o t there") and toxicity.words("(Hello!)".lower()) == ["^hello$"]
    assert toxicity.words("abc") == ["^abc$"] and toxicity.words("ab") == [] and toxicity.words("!") == [] and toxicity.words("") == []
    long = toxicity.words("x" * 100)
    assert all(len(w) <= toxicity.LONGEST for w in long) and len(long) > 8


def test_toxicity(spark, docs):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        words, bad = sentence(rng, rng.randint(6, 40)).split(), rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((" ".join(words), int(bad)))
    df = docs([t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, learn=~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).withColumn("held", toxicity.held_out()).filter("held").collect()}
    assert np.mean([(s >= toxicity.THRESHOLD) == (rows[i][1] == 1) for i, s in got.items()]) > 0.95
    hidden = [f"The council met {w} at the bridge." for w in ("grob-nik", "grobxnik", "gro.bnik", "zaltraash")]
    odd = toxicity.scored(docs([None, "", "!!", "é" * 5000, sentence(rng), "a b c", *hidden]), model).orderBy("doc_id").collect()
    assert all(r.score < toxicity.THRESHOLD for r in odd[:6]) and sum(r.score >= toxicity.THRESHOLD for r in odd[6:]) >= 3
    assert toxicity.scored(docs([]), model).count() == 0
    for some, want in ((labels.limit(0), 0.5), (labels.filter("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.scored(docs(["a"]), toxicity.fit(df, some)).collect()} == {want}
