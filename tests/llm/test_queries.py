"""The registered queries over the smallest tables, column by column, against libraries and brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from broadsheet.llm import bpe, common, exact, extract, media, packing, quality, secrets, toxicity
from tests.llm.test_text_media import brute_spans
from tests.llm.test_tokens import tiktoken_encoding  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(sample):
    return {i: t or "" for i, t in sample}


def rows_of(df):
    rows = df.collect()
    got = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    return got


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts, tiktoken_encoding):  # noqa: F811
    got = rows_of(bpe.query(spark, SF))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array(tiktoken_encoding.encode_ordinary(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(t.encode()))


def test_op3(spark, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    got = rows_of(exact.query(spark, SF))
    assert got.keys() == texts.keys()
    for plain, own in groups.items():
        keep = min(own, key=lambda i: (-len(texts[i]), i))
        for i in own:
            assert tuple(got[i]) == (i, keep, len(own), i == keep, sha(plain.encode()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("exact_index_")]


def test_op3_through_a_lasting_index(spark, docs):
    index = exact.DigestIndex(spark, "own_index")
    try:
        first = rows_of(exact.dedup(docs(["a b", "c", "ab "], [1, 2, 3]), index))
        assert [(first[i].keep_id, first[i].group_size, first[i].kept) for i in (1, 2, 3)] == [(1, 2, True), (2, 1, True), (1, 2, False)]
        second = rows_of(exact.dedup(docs([" a b  ", "d", "d"], [4, 5, 6]), index))
        assert [(second[i].keep_id, second[i].kept) for i in (4, 5, 6)] == [(1, False), (5, True), (5, False)]
        assert sorted(r.keep_id for r in index.read().collect()) == [1, 2, 5]
    finally:
        index.drop()


def test_op4(spark, texts):
    got = rows_of(quality.query(spark, SF))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op4_solution_is_that_of_the_whole_matrix(spark, texts):
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    label = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    ids = sorted(label)
    x, y = np.array([quality.statistics(texts[i]) for i in ids]), np.array([label[i] for i in ids])
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, scale)
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    from pyspark.sql import functions as F

    apart = {r.id for r in rows.filter(F.pmod(F.xxhash64(F.lit(quality.SEED + 1), "id"), F.lit(quality.CALIBRATION)) == 0).collect()}
    used = np.array([i not in apart for i in ids])
    z = model.features(x[used])
    width = z.shape[1]
    # Ridge regression as least squares with further rows.
    extra = np.sqrt(quality.RIDGE * len(ids) / quality.FEATURES) * np.eye(width)
    want = np.linalg.lstsq(np.vstack([z, extra]), np.concatenate([y[used], np.zeros(width)]), rcond=None)[0]
    assert np.allclose(z @ model.solution, z @ want, atol=1e-6)


def test_isotonic_against_all_runs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        raw, y = np.sort(rng.normal(size=n)), rng.integers(0, 2, n).astype(float)
        knots, values = quality.isotonic(raw, y)
        fitted = np.interp(raw, knots, values) if len(knots) > 1 else np.full(n, values[0])
        assert (np.diff(values) >= 0).all() and (np.diff(fitted) >= -1e-12).all()
        # The least squares fit without the prior: at each place the greatest of the least means of runs.
        best = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        order = [(values[np.searchsorted(knots, r).clip(0, len(knots) - 1)], w) for r, w in zip(raw, best)]
        assert all((a - c) * (b - d) >= -1e-9 for a, b in order for c, d in order)


def test_op5(spark, texts, file_vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file_vocabulary[0])
    rows = packing.query(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, *c) for k, c in enumerate(packing.cut(len(ids), 2048))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        total += len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 2048
    assert len(sequences) <= total / 2048 * 1.02 + 2


def test_op5_many_groups_and_repeated_rows(docs, file_vocabulary):
    made = packing.pieces(docs(["one two three"] * 300 + ["k"] * 50, [7] * 300 + [None] * 50), *file_vocabulary, length=16, keep=["doc_id"])
    made = common.stash(made, "pieces")
    rows = packing.place(made, made.count(), length=16, group=40).collect()
    assert len(rows) == 350
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len({s >> 40 for s in sequences}) > 3
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 16
    with pytest.raises(ValueError):
        packing.place(made.withColumnRenamed("piece", "offset"), 1)
    with pytest.raises(ValueError):
        packing.pieces(docs(["a"]).withColumnRenamed("word", "Length"), *file_vocabulary)


def test_op6(spark, texts, vocabulary):
    count = secrets.Counter(*vocabulary)
    got = rows_of(secrets.query(spark, SF))
    assert got.keys() == texts.keys()

    def joined(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    for i, t in texts.items():
        base = brute_spans(t)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(joined(base).encode()) and r.spans == joined(secrets.scan_text(t, count))


def test_op7(spark):
    pages = {r.page_id: r for r in common.table(spark, SF, "pages").collect()}
    got = rows_of(extract.query(spark, SF))
    assert got.keys() == pages.keys()
    seen = 0
    for i, r in got.items():
        assert r.url == pages[i].url and r.n_chars == len(r.text)
        inside = re.findall(r"<article>(.*?)</article>", pages[i].html, re.DOTALL)
        if len(inside) == 1 and not re.search(r"<(?!/?(p|h1|b|br)\b)", inside[0]):
            parts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside[0])]
            assert r.text == "\n\n".join(p for p in parts if p)
            seen += 1
    assert seen > len(pages) / 2


def test_op7_without_telling_names(spark):
    # The weights find the main text where there is no article element and no class to tell it by.
    pages = common.table(spark, SF, "pages")
    costs, default = extract.learn(pages)
    same = every = 0
    for r in pages.collect():
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"</?(article|main)\b[^>]*>", "", r.html))
        bare = re.sub(r"<(/?)(nav|footer|aside|header|form)\b", r"<\1div", bare)
        same += extract.main_text(bare, costs, default) == extract.main_text(r.html, costs, default)
        every += 1
    # Learnt from these 50 pages alone.
    assert same >= 0.9 * every


def test_op7_adverts_inside_do_not_end_the_article(spark):
    # None of these elements stands inside of an article on the pages that the weights come from.
    costs, default = extract.learn(common.table(spark, SF, "pages"))
    long = " ".join(["word"] * 60)
    page = (
        f"<body><nav><a>{long}</a></nav><article><h1>Head</h1><p>{long}</p><div class='ad'><ul><li><a>Buy {long}</a></li></ul></div><p>Then.</p><form><select><option>{long}</option></select></form>"
        f"<table><tr><td>a</td><td>b</td></tr></table><aside><p>{long}</p></aside><ul><li><a>End</a></li></ul></article><footer>{long}</footer></body>"
    )
    assert extract.main_text(page, costs, default) == f"Head\n\n{long}\n\nThen.\n\na b\n\nEnd"
    two = f"<main><article><p>{long} one</p></article><article><p>few words</p></article></main>"
    assert extract.main_text(two, costs, default) == f"{long} one"


def test_op9(spark, texts):
    got = rows_of(toxicity.query(spark, SF))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op10(spark, texts):
    got = rows_of(media.query(spark, SF))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        stored = media.store_payload(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored)) and r.feature


def test_media_clashing_names(docs):
    df = docs(["a"]).selectExpr("doc_id", "encode(text, 'utf-8') AS payload", "word AS media")
    with pytest.raises(ValueError):
        media.store(df)
    with pytest.raises(ValueError):
        media.read_back(media.store(df, out="stream"), media="stream", out="Media")
