"""BPE and packing against the libraries, on odd texts and exact round trips."""

import base64
import random
import zlib

import numpy as np
import pytest

from broadsheet.llm import bpe, packing

rng = random.Random(4)
ODD = [
    None, "", " ", "\n\n  \t", "a", "don't I'LL we've", "   lead and trail   ", "naïve café ☃ 日本語 𝔘𝔫𝔦", "a" * 700, " " * 300 + "x", "=" * 200, "x<|endoftext|>y", "\x00\x1c\x85",
    *("".join(rng.choice("ab 's\n\té日<|>!?.,0127") for _ in range(200)) for _ in range(40)), "a", "a",
]


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encode_decode(spark, docs, vocabulary, tiktoken_encoding, sample):
    texts = ODD + [t for _, t in sample[:60]]
    encoded = bpe.encode(docs(texts), *vocabulary)
    assert encoded.columns[-1] == "ids" and "word" in encoded.columns
    rows = bpe.decode(encoded, *vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == tiktoken_encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_small_cache_gives_the_same(vocabulary, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    codec = bpe.Codec(*vocabulary)
    for t in ODD[3:20]:
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == tiktoken_encoding.encode_ordinary(t)


def test_very_long_words(vocabulary, tiktoken_encoding):
    own = random.Random(7)
    some = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "a" * 100_001, "ab" * 3000 + "a", "thecatsatonthematandthen" * 60, "".join(own.choice(["a" * own.randrange(1, 400), "b"]) for _ in range(40)), "=" * 50_000, "日本語" * 3000]
    codec = bpe.Codec(*vocabulary)
    for t, ids in zip(some, codec.encode(some)):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == tiktoken_encoding.encode_ordinary(t), t[:20]
        assert codec.decode(got.astype(np.int32), np.array([len(got)])) == [t.encode()]


def test_empty_and_null_lists(spark, docs, vocabulary):
    assert bpe.encode(docs([]), *vocabulary).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, *vocabulary).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        bpe.encode(df, *vocabulary, text="ids")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), *vocabulary).collect()


def test_transcode_in_one_worker(spark, docs, vocabulary, monkeypatch):
    # One Python worker, so one codec, for a task of op1; the same ids and bytes as by encode and decode, also if few ids are decoded at once.
    monkeypatch.setattr(bpe, "CHUNK_IDS", 50)
    df = docs(ODD)
    both = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, *vocabulary), *vocabulary).collect()}
    got = bpe.transcode(df, *vocabulary, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all((np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) == both[r.doc_id] for r in got)
    plan = bpe.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Arrow" in x or "Python" in x]) == 1
    with pytest.raises(ValueError):
        bpe.transcode(docs([]).withColumnRenamed("word", "decoded"), *vocabulary)


def test_ids_are_those_of_tokenizers(file_vocabulary, sample):
    from tokenizers import Tokenizer

    ids, tokenizer = packing.Ids(*file_vocabulary), Tokenizer.from_file(file_vocabulary[0])
    for t in [t or "" for t in ODD] + [t for _, t in sample]:
        assert np.frombuffer(ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def brute_best_fit(lengths, size):
    rooms, out = [], []
    for n in lengths:
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            room = min(r for r, _ in fit)
            k = next(k for r, k in fit if r == room)
        else:
            rooms.append(size)
            k = len(rooms) - 1
        out.append(size - rooms[k])
        rooms[k] -= n
    return len(rooms), out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_against_a_scan(seed):
    own = random.Random(seed)
    lengths = sorted((own.randint(1, 64) for _ in range(400)), reverse=True)
    sequences, offsets = packing.best_fit(lengths, 64)
    n, want = brute_best_fit(lengths, 64)
    assert max(sequences) + 1 == n and sorted(offsets) == sorted(want)


def test_cut():
    assert list(packing.cut(5, 8)) == [(0, 5)] and list(packing.cut(8, 8)) == [(0, 8)] and list(packing.cut(19, 8)) == [(0, 3), (3, 8), (11, 8)]


def test_pack(docs, file_vocabulary, sample):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file_vocabulary[0])
    texts = ODD + [t for _, t in sample]
    rows = packing.pack(docs(texts), *file_vocabulary, length=256).collect()
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == list(packing.cut(len(ids), 256))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        total += len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by) <= total / 256 * 1.02 + 2
    assert packing.pack(docs([]), *file_vocabulary).count() == 0
