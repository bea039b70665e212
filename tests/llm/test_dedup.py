"""Exact copies, near copies and lines against brute force, with hot groups, ties and odd rows."""

import hashlib
import random
import re
import uuid

import numpy as np
import pytest

from broadsheet.llm import common, exact, graph, lines, near

WORDS = [f"w{i}" for i in range(400)]


def index(spark):
    return exact.DigestIndex(spark, f"exact_{uuid.uuid4().hex}", buckets=4)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact(spark, docs):
    texts = [None, "", " \n", "a b", "ab", "a  b", "ab ", "xyz", "x y z ", "é", *["hot text"] * 300, *["hottext"] * 5]
    found = exact.dedup(docs(texts), own := index(spark)).collect()
    assert len(found) == len(texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(squeezed(t), []).append(i)
    for r in found:
        group = groups[squeezed(texts[r.doc_id])]
        keep = min(group, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), keep == r.doc_id)
        assert bytes(r.digest).hex() == hashlib.sha256(squeezed(texts[r.doc_id]).encode()).hexdigest()
    again = exact.dedup(docs(["a b", "new", "xyz"], [900, 901, 902]), own).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in again} == {900: (5, False), 901: (901, True), 902: (8, False)}
    assert own.read().count() == len(groups) + 1
    own.drop()


def test_exact_null_ids_repeats_and_no_rows(spark, docs):
    own = index(spark)
    got = exact.dedup(docs(["a", "a", "b", "b"], [None, 7, 3, 3]), own).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in got) == [("3", 3, True), ("3", 3, True), ("7", 7, True), ("None", 7, False)]
    assert exact.dedup(docs([]), own).count() == 0
    own.drop()


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def variants(seed, base=60, n=60):
    rng = random.Random(seed)
    first = [rng.choice(WORDS) for _ in range(base)]
    out = [" ".join(first)]
    for _ in range(n):
        words = list(rng.choice(out).split()) if rng.random() < 0.4 else list(first)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near(docs, percent):
    texts = [None, "", " \t", "one two", "ONE  two", "one two three four five six seven", "one two three four five six seven eight"]
    texts += variants(1) + variants(2, 200, 20) + variants(3, 12, 15)
    sets = [shingles(t) for t in texts]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    want = brute_components(len(texts), linked)
    got = {r.doc_id: r for r in near.groups(docs(texts), near.Rule(percent)).collect()}
    assert len(got) == len(texts)
    assert [got[i].component for i in range(len(texts))] == want
    assert [got[i].n for i in range(len(texts))] == [len(s) for s in sets]


def test_near_odd_rows(docs):
    a, b = "k1 k2 k3 k4 k5 k6 k7 k8 k9", "unlike anything else in this table at all"
    got = near.groups(docs([a, a, b, b, None, a], [None, 9, 4, 4, 5, 12]), near.Rule()).collect()
    assert sorted((str(r.doc_id), r.component) for r in got) == [("12", 9), ("4", 4), ("4", 4), ("5", 5), ("9", 9), ("None", 9)]
    assert near.groups(docs([]), near.Rule()).count() == 0
    many = " ".join(WORDS) + " "
    got = near.groups(docs([many, many + "x", "y " + many], [None, None, None]), near.Rule()).collect()
    assert {r.component for r in got} == {None}


def test_near_ids_of_any_kind(spark, docs):
    a, b = "k1 k2 k3 k4 k5 k6 k7 k8 k9", " ".join(WORDS[:60])
    got = {r.doc_id: r.component for r in near.groups(docs([a, a, a, b, b + " x", "y " + b], [-5, -4, 3, -2, -(2**62), 7]), near.Rule()).collect()}
    assert got == {-5: -5, -4: -5, 3: -5, -2: -(2**62), -(2**62): -(2**62), 7: -(2**62)}
    rows = [("q", b), ("p", b + " x"), (None, "y " + b), ("r", None), ("s", "other words of no kin to them at all")]
    got = {r.id: r.component for r in near.groups(spark.createDataFrame(rows, "id string, text string"), near.Rule(), "id").collect()}
    assert got == {"q": "p", "p": "p", None: "p", "r": "r", "s": "s"}
    # Rows that share an id are one document, whatever their texts.
    got = sorted((r.doc_id, r.component) for r in near.groups(docs([a, b, a + " z", b], [4, 4, 9, 2]), near.Rule()).collect())
    assert got == [(2, 2), (4, 2), (4, 2), (9, 2)]


def test_near_very_long_texts(docs):
    rng = random.Random(11)
    long = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60_000)]
    texts = [" ".join(long), " ".join(long[:59_000]), " ".join(long[30_000:])]
    got = {r.doc_id: r for r in near.groups(docs(texts), near.Rule()).collect()}
    assert [got[i].component for i in range(3)] == [0, 0, 2] and got[0].n == len(shingles(texts[0]))


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for n in (1, 2, 30, 5000):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            assert (near.sketch(x, 120) != near._EMPTY).all()
        a = rng.integers(0, 2**63, 900).astype(np.uint64)
        b = np.concatenate([a[:600], rng.integers(0, 2**63, 300).astype(np.uint64)])
        assert abs((near.sketch(a, 600) == near.sketch(b, 600)).mean() - 0.5) < 0.08


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.x: r.y for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    pairs = {(place[a], place[b]) for a, b in edges} | {(place[b], place[a]) for a, b in edges}
    want = brute_components(len(nodes), lambda a, b: (a, b) in pairs)
    assert {x: got.get(x, x) for x in nodes} == {x: nodes[want[i]] for x, i in place.items()}


def brute_lines(texts, similar=80):
    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words:
                kept.append(line)
                continue
            if not any(100 * len(words & s) >= similar * len(words | s) for s in seen):
                kept.append(line)
            seen.append(words)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_lines(docs):
    rng = random.Random(6)
    pool = [v for s in range(6) for v in variants(s, rng.choice([3, 5, 10, 25]), 6)]
    texts = [None, "", "\n\n", "one\none\r\n one ", "a b c d e", "a b c d", "a\tb  c d f", "a b\n\nc d"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = {r.doc_id: r for r in lines.dedup(docs(texts)).collect()}
    want = brute_lines(texts)
    assert [rows[i].text for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert rows[i].n_lines == (0 if t is None else len(t.split("\n")))
        assert rows[i].n_removed == (0 if t is None else len(t.split("\n")) - len(want[i].split("\n")) if want[i] or rows[i].n_removed < rows[i].n_lines else rows[i].n_lines)
    assert rows[0].word == "w"


def test_lines_odd_rows(docs):
    got = lines.dedup(docs(["x y z", "x y z", "q"], [None, 5, 5])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", "q"), ("5", "x y z"), ("None", "")]
    assert lines.dedup(docs([])).count() == 0
    for ids in ([None, None, None, 5], [7, 7, 7, 5]):
        # A line of one row is a copy, the others' at its place are not; the last two rows' lines at one place are both compared.
        texts = ["a b c d e\nown one here", "unlike that line\nk l m n o p q r s t u", "first of all these\nv w x y z k l m n o", "a b c d e\nk l m n o p q r s t\nv w x y z k l m n"]
        left = {r.text for r in lines.dedup(docs(texts, ids)).collect()}
        assert left == {"own one here", "unlike that line", "first of all these", texts[3]}
    with pytest.raises(ValueError):
        lines.dedup(docs(["a"]).withColumnRenamed("word", "n_lines"))


def test_lines_crowded_words(docs, monkeypatch):
    # Queues of over HOT classes, under one word and under two; one word in all lines; unlike lines that share their rarest words.
    monkeypatch.setattr(lines, "HOT", 3)
    rng = random.Random(8)
    common_words = [f"c{i}" for i in range(6)]
    texts = []
    for i in range(70):
        own = rng.sample(common_words, 3) + [f"f{i % 9}", f"f{(i * 5) % 11}", "always"]
        texts.append("\n".join([" ".join(own), " ".join(["always", *rng.sample(WORDS, 9)]), " ".join(["rare1", "rare2", *rng.sample(WORDS[:14], 8)])]))
    rows = {r.doc_id: r.text for r in lines.dedup(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_lines(texts)


def test_lines_plans_are_small(docs):
    # The driver keeps the text of a plan for each query; the table of the words' rarities is not in it.
    rows = lines.numbered(docs(["a b c d", "a b a"]), "doc_id", "text")[0]
    (levels,) = (table := lines.rarities(rows)).first()
    assert len(levels) == lines.BUCKETS and sorted(x >> 56 for x in levels if x) == [2, 2, 3, 4]
    assert len(lines._line_sets(rows, table, lines.SIMILAR)._jdf.queryExecution().toString()) < 200_000


def test_lines_of_many_lengths(docs, monkeypatch):
    # Similar lines, the longer or the shorter one first, around the limits of length and of prefixes; short queues, and ones that go on by pairs of words.
    rng = random.Random(11)
    texts = []
    for s in range(40):
        n = rng.choice([4, 5, 8, 9, 10, 16, 20, 25, 45, 100, 125])
        words = [f"v{rng.randrange(60)}" if rng.random() < 0.3 else f"w{s}x{i}" for i in range(n)]
        other = words[: max(1, round(n * rng.choice([0.78, 0.8, 0.82, 0.9])))]
        other = other + [f"u{s}x{i}" for i in range(rng.choice([0, 0, n // 10]))]
        texts += rng.sample([" ".join(words), " ".join(rng.sample(other, len(other)))], 2)
    rng.shuffle(texts)
    want = brute_lines(texts)
    assert 0 < sum(t == "" for t in want) < 40
    for hot in (lines.HOT, 2):
        monkeypatch.setattr(lines, "HOT", hot)
        rows = {r.doc_id: r.text for r in lines.dedup(docs(texts)).collect()}
        assert [rows[i] for i in range(len(texts))] == want


def test_lines_meet_by_length(docs, monkeypatch):
    # Classes that share a word meet only where their lengths are near; both sides read one exchange, and neither is sorted.
    plans = []
    stash = common.stash
    monkeypatch.setattr(common, "stash", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), stash(df, label))[1])
    texts = [" ".join(f"{c}{i % 7 if i < 2 else i}" for i in range(n)) for n in (10, 12, 60) for c in "ab"]
    assert [r.text for r in lines.dedup(docs(texts)).orderBy("doc_id").collect()] == brute_lines(texts)
    (plan,) = [p for label, p in plans if label == "partners" and "bits0" in p]
    assert re.search(r"ShuffledHashJoin \[token#\d+, step#\d+\], \[token#\d+, step#\d+\]", plan) and not re.search("SortMergeJoin|Window", plan)
    exchanges = re.findall(r"Exchange hashpartitioning\(token#\d+, ", plan)
    assert exchanges and "step" not in "".join(re.findall(r"Exchange [^\n]*", plan))


def test_lines_behind_a_match(docs, monkeypatch):
    # Under "key", the class right behind HOT others is like the first; the two behind it are like each other alone, and share no other word of their prefixes.
    monkeypatch.setattr(lines, "HOT", 3)
    head, one, two, pair = ([f"{x}{i}" for i in range(9 if x != "s" else 7)] for x in "hpqs")
    queue = [["key", *head], ["key", *one], ["key", *two], ["key", *head, "more"], ["key", *pair], ["own1", "own2", "key", *pair]]
    texts = ["\n".join([*head, *one, *two, *pair, "more"] * 40)] + [" ".join(words) for words in queue]
    rows = {r.doc_id: r.text for r in lines.dedup(docs(texts)).collect()}
    assert rows[len(texts) - 1] == "" and [rows[i] for i in range(len(texts))] == brute_lines(texts)


def test_lines_long_texts_and_repeats(docs):
    # 70,000 lines in one text, of which every third is new; the same text again loses all its lines.
    many = "\n".join(f"w{i // 3} x{i // 3} y{i // 3} z{i // 3}" for i in range(70_000))
    got = {r.doc_id: r for r in lines.dedup(docs([many, many, "own line here"])).collect()}
    assert (got[0].n_lines, got[0].n_removed, got[1].n_removed, got[1].text, got[2].text) == (70_000, 70_000 - 23_334, 70_000, "", "own line here")
    assert got[0].text.split("\n")[:2] == ["w0 x0 y0 z0", "w1 x1 y1 z1"]


def test_lines_rows_without_number(spark):
    # Ids that are no numbers: rows are put in order by them.
    rows = [("b", "k l m n o p q r s t u"), ("a", "k l m n o p q r s t"), (None, "k l m n o p q r s t v"), ("c", None)]
    got = {r.id: r.text for r in lines.dedup(spark.createDataFrame(rows, "id string, text string"), "id").collect()}
    assert got == {"a": rows[1][1], "b": "", None: "", "c": None}
