"""Text features of pairs against difflib, dictionaries and sets."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from broadsheet.functions import ratio
from broadsheet.operators import pair_text


def test_ratios_are_those_of_difflib(monkeypatch):
    rng = random.Random(3)
    alphabets = ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz   eeee", "".join(chr(0x4E00 + k) for k in range(300)), "a\u00e9\U0001f600b"]

    def some(letters):
        return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 20, 150, 199, 200, 201, 500])))

    cases = [("xy" * 900 + "q", "xy" * 900 + "z")]
    for _ in range(600):
        letters = rng.choice(alphabets)
        a = some(letters)
        b = list(a)
        for _ in range(rng.randrange(8)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(6)] = some(letters)[: rng.randrange(6)]
        cases.append((a, "".join(b) if rng.random() < 0.5 else some(letters)))
    want = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in cases]
    for held, most in ((1_000_000, 4_000_000), (500, 4_000_000), (1_000_000, 100)):
        monkeypatch.setattr(ratio, "HELD", held)
        monkeypatch.setattr(ratio, "MOST_OF_PAIR", most)
        alphabet = ratio.Alphabet()
        assert list(ratio.ratios((ratio.Text(a, alphabet), ratio.Text(b, alphabet)) for a, b in cases)) == want


def test_ratios_in_a_tenth_of_the_time():
    import time

    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin shrdlu etaoin etaoin cmfwypvbgkqjxz,.") for _ in range(3000)) for _ in range(12)]
    pairs = [(a, b) for a in texts for b in texts]
    began = time.process_time()
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs[:24]]
    old = (time.process_time() - began) * len(pairs) / 24
    alphabet = ratio.Alphabet()
    known = {t: ratio.Text(t, alphabet) for t in texts}
    began = time.process_time()
    got = list(ratio.ratios((known[a], known[b]) for a, b in pairs))
    assert got[:24] == want and (time.process_time() - began) * 4 < old


def brute_cosine(blocks, left, right, most):
    """blocks: texts of one newspaper by block."""
    counts = {}
    for b, t in blocks.items():
        words = re.findall(r"\b\w\w+\b", " ".join((t or "").split()).lower())
        counts[b] = Counter(words + [f"{x} {y}" for x, y in zip(words, words[1:])])
    total = sum(counts.values(), Counter())
    kept = set(sorted(total, key=lambda w: (-total[w], w.encode()))[:most])
    held = Counter(w for c in counts.values() for w in c if w in kept)
    raw = {b: {w: n * (math.log((len(blocks) + 1) / (held[w] + 1)) + 1) for w, n in c.items() if w in kept} for b, c in counts.items()}
    a, b = raw.get(left, {}), raw.get(right, {})
    return sum(x * b[w] for w, x in a.items() if w in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if set(a) & set(b) else None


@pytest.mark.parametrize("most", [7, 50_000])
def test_features_of_pairs(spark, most):
    rng = random.Random(5)
    words = "Ab ab abc ab_c Zoe zoe New York \u00c9t\u00e9 x 12 don't pear apple".split()
    papers = {p: {f"{p}{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(9))) for i in range(9)} for p in "pq"}
    papers["p"] |= {"p0": None, "p1": "  \n", "p2": "same thing Here", "p3": "same  thing Here"}
    rows = [(p, 0, b, i, t) for p, blocks in papers.items() for i, (b, t) in enumerate(blocks.items())]
    # Of rows of one block the first counts; rows without newspaper are no corpus.
    rows += [("p", 0, "p4", 99, "another text of it"), (None, 0, "n1", 1, "same thing"), (None, 0, "n2", 2, "same thing")]
    pairs = [(p, 0, a, b) for p, blocks in papers.items() for a in blocks for b in blocks if a != b] + [("q", 0, "q1", "gone"), ("r", 0, "r1", "r2"), (None, 0, "n1", "n2")]
    blocks = spark.createDataFrame(rows, "newspaper_id string, image_id int, block_id string, ord long, ocr_text string")
    table = spark.createDataFrame([(f"{a}-{b}", *x) for x in pairs for a, b in [x[2:]]], "pair_id string, newspaper_id string, image_id int, left_block_id string, right_block_id string")
    got = {r.pair_id: r for r in pair_text.features(table, blocks, most=most).collect()}
    text = {b: " ".join((t or "").split()).lower() for p in papers.values() for b, t in p.items()} | {"n1": "same thing", "n2": "same thing"}
    want = {f"{a}-{b}": brute_cosine(papers.get(p, {}), a, b, most) for p, _, a, b in pairs}
    assert len(got) == len(pairs) and {k: round(r.ocr_cosine_similarity, 9) for k, r in got.items()} == {k: round(c or 0.0, 9) for k, c in want.items()}
    for p, _, a, b in pairs:
        x, y = text.get(a, ""), text.get(b, "")
        assert got[f"{a}-{b}"].text_similarity == (SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    r = got["p2-p3"]
    assert (r.entity_overlap, r.shared_keywords) == (1.0, 3) and (got["p0-p2"].entity_overlap, got["q1-gone"].shared_keywords) == (0.0, 0)
    met = {r.pair_id for r in pair_text.cosines(table, blocks, most).collect()}
    assert met == {k for k, c in want.items() if c is not None}
    ratios = {r.pair_id: r.text_similarity for r in pair_text.sequence_ratios(table, blocks).collect()}
    assert ratios == {k: r.text_similarity for k, r in got.items()}
    assert {r.text_similarity for r in pair_text.features(table, blocks, False).collect()} == {0.0}
    # Blocks that are not kept are no part of the corpus.
    some = blocks.filter("newspaper_id = 'p' AND ord < 6")
    cut = {b: t for b, t in list(papers["p"].items())[:6]}
    got = {r.pair_id: r.ocr_cosine_similarity for r in pair_text.features(table.filter("newspaper_id = 'p'"), blocks, False, most, some).collect()}
    assert {k: round(c, 9) for k, c in got.items()} == {f"{a}-{b}": round(brute_cosine(cut, a, b, most) or 0.0, 9) for p, _, a, b in pairs if p == "p"}
