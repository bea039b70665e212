"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding: a text is split by the vocabulary's pattern; every word that the worker has not met yet becomes rows
(word, position, token) of single bytes. A recursive query joins neighbouring tokens with the merge table and contracts
each word's leftmost pair of minimum rank, until no pair of the word is left. Words that are themselves tokens need no
contraction. Decoding: token rows join the vocabulary, and an ordered aggregation puts each text's together by their positions.

Long words: a word is first cut between two bytes that no token has side by side, as no pair is ever contracted there. What is left of more
than LONG bytes is contracted at many places in a round: every pair of minimum rank among all that lie so near that a token
could reach it (CONTRACT_LONG). Until that pair is contracted nothing else changes around it, so the result is the same. A word of n bytes
takes some hundred rounds of n rows, whatever n is; by single pairs it would take n rounds.

Defined results: null text counts as empty, empty text has no tokens, a null list of ids decodes to empty bytes; an id
outside the vocabulary raises ValueError. Repeated rows stay, each with its own result. Other columns are kept; an output
name that the input already has raises ValueError. The words that a worker remembers are bounded by CACHE_WORDS.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Distinct words that a worker keeps; when the next chunk would exceed it, it starts anew.
CACHE_WORDS = 400_000
#: Characters whose words are held at once, and ids decoded at once (a longer single text goes alone).
CHUNK_CHARS = 2_000_000
CHUNK_IDS = 1_000_000

#: b packs a pair's rank and position, so that the smallest b is the leftmost pair of minimum rank.
CONTRACT = """
WITH RECURSIVE s(word, pos, token, next_token, next_pos, live) AS (
  SELECT word, pos, token, next_token, next_pos, true FROM start
  UNION ALL
  SELECT word, pos,
    CASE WHEN pos = place THEN merged ELSE token END,
    CASE WHEN pos = place THEN after_token WHEN next_pos = place THEN merged ELSE next_token END,
    CASE WHEN pos = place THEN after_pos ELSE next_pos END,
    place IS NOT NULL
  FROM (
    SELECT a.word, a.pos, a.token, a.next_token, a.next_pos, c.place, c.merged, c.gone, c.after_token, c.after_pos
    FROM (SELECT * FROM s WHERE live) a
    LEFT JOIN (
      SELECT m.word, (m.b & 4294967295)::INT AS place, (m.b >> 32)::INT AS merged, m.gone,
        n.next_token AS after_token, n.next_pos AS after_pos
      FROM (
        SELECT word, min((merged::BIGINT << 32) | pos) AS b, arg_min(next_pos, (merged::BIGINT << 32) | pos) AS gone
        FROM s JOIN merges ON token = merges.l AND next_token = merges.r WHERE live GROUP BY word
      ) m JOIN s n ON n.word = m.word AND n.pos = m.gone
    ) c ON a.word = c.word
  )
  WHERE place IS NULL OR pos <> gone
)
SELECT word, token FROM s WHERE NOT live ORDER BY word, pos
"""

#: Pairs of equal rank that overlap (aaa) are contracted from the left, every other one; such a run waits until all of it is of minimum rank.
CONTRACT_LONG = """
WITH RECURSIVE s(word, pos, token, live) AS (
  SELECT word, pos, token, true FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN chosen THEN merged ELSE token END, any_chosen
  FROM (
    SELECT word, pos, token, merged, chosen, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone, bool_or(chosen) OVER (PARTITION BY word) AS any_chosen
    FROM (
      SELECT word, pos, token, merged,
        coalesce(bool_and(hit) OVER (PARTITION BY word, run), false) AND row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1 AS chosen
      FROM (
        SELECT word, pos, token, merged, merged IS NOT NULL AND merged = least AS hit,
          sum(CASE WHEN merged IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
          SELECT word, pos, token, merged, lag(merged) OVER (PARTITION BY word ORDER BY pos) AS before,
            min(merged) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least
          FROM (SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next_token FROM s WHERE live) LEFT JOIN merges ON token = l AND next_token = r
        )
      )
    )
  )
  WHERE NOT gone
)
SELECT word, token FROM s WHERE NOT live ORDER BY word, pos
"""

#: Bytes of a piece of a word above which pairs are contracted at many places at once.
LONG = 64

DECODE = "SELECT list(bytes ORDER BY pos) AS parts FROM ids JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc"


class Codec:
    """A vocabulary in a DuckDB database in memory; one per worker process and vocabulary."""

    held: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.words: dict[str, bytes] = {}
        #: Which two bytes stand side by side in some token.
        self.neighbours = np.zeros(1 << 16, bool)
        for token in self.ranks:
            own = np.frombuffer(token, np.uint8).astype(np.int32)
            self.neighbours[own[:-1] * 256 + own[1:]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": common.worker_temp()})
        pairs = [(x, y, m) for word, m in self.ranks.items() for k in range(1, len(word)) if (x := self.ranks.get(word[:k])) is not None and (y := self.ranks.get(word[k:])) is not None]
        self._table("merges", dict(zip("lrm", np.array(pairs, dtype=np.int32).reshape(-1, 3).T)))
        self.db.execute("ALTER TABLE merges RENAME m TO merged")
        self._table("vocabulary", {"token": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.held:
            cls.held[path, pattern] = cls(path, pattern)
        return cls.held[path, pattern]

    def learn(self, words: list[str]) -> None:
        """Contracts words and remembers their ids as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        todo = []
        for word, b in zip(words, raw):
            if (whole := self.ranks.get(b)) is not None:
                self.words[word] = whole.to_bytes(4, "little")
            else:
                todo.append((word, b))
        if not todo:
            return
        pieces, owner = [], []
        for i, (_, b) in enumerate(todo):
            own = self.cut(b)
            pieces += own
            owner += [i] * len(own)
        done = [b""] * len(pieces)
        for query, some in ((CONTRACT, [i for i, b in enumerate(pieces) if len(b) <= LONG]), (CONTRACT_LONG, [i for i, b in enumerate(pieces) if len(b) > LONG])):
            if some:
                for i, ids in zip(some, self.contract(query, [pieces[i] for i in some])):
                    done[i] = ids
        found: dict[int, list[bytes]] = {}
        for i, ids in zip(owner, done):
            found.setdefault(i, []).append(ids)
        for i, (text, _) in enumerate(todo):
            self.words[text] = b"".join(found[i])

    def cut(self, word: bytes) -> list[bytes]:
        """A word as it is, or, if it is long, in pieces between which nothing is contracted."""
        if len(word) <= LONG:
            return [word]
        own = np.frombuffer(word, np.uint8).astype(np.int32)
        ends = [*(np.flatnonzero(~self.neighbours[own[:-1] * 256 + own[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip([0, *ends], ends)]

    def contract(self, query: str, some: list[bytes]) -> list[bytes]:
        """Ids of each piece of a word, by one of the recursive queries."""
        length = np.array([len(b) for b in some])
        token = self.single[np.frombuffer(b"".join(some), dtype=np.uint8)]
        word = np.repeat(np.arange(len(some), dtype=np.int32), length)
        pos = (np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        last = np.cumsum(length) - 1
        next_token, next_pos = np.append(token[1:], 0).astype(np.int32), pos + 1
        next_token[last] = next_pos[last] = -1
        self.db.register("start", pa.table({"word": word, "pos": pos, "token": token, "next_token": next_token, "next_pos": next_pos.astype(np.int32)}))
        # A pair ends two tokens behind its place; what could reach it lies less than one token further. Only tokens of these bytes can come up.
        used = set(b"".join(some))
        longest = max(len(t) for t in self.ranks if used.issuperset(t)) if query is CONTRACT_LONG else 0
        done = self.db.sql(query.format(reach=3 * longest)).to_arrow_table()
        self.db.unregister("start")
        owner, ids = done.column("word").to_numpy(), done.column("token").to_numpy().astype("<u4")
        ends = (np.searchsorted(owner, np.arange(len(some)), side="right") * 4).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        new = set()
        for words in split:
            new.update(words)
        if len(new) + len(self.words) > CACHE_WORDS:
            self.words.clear()
        else:
            new.difference_update(self.words)
        if new:
            self.learn(sorted(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of consecutive lists of ids; ends: where each list ends in ids."""
        if not len(ids):
            return [b""] * len(ends)
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "token": ids.astype(np.int32)}))
        parts = self.db.sql(DECODE).to_arrow_table().column("parts").combine_chunks()
        self.db.unregister("ids")
        # The texts' lists follow each other, so the bytes of all lie in one run.
        out = parts.flatten().cast(pa.large_binary())
        if len(out) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        offsets = np.frombuffer(out.buffers()[1], dtype=np.int64)[out.offset : out.offset + len(out) + 1]
        data, begin, result = memoryview(out.buffers()[2]), int(offsets[0]), []
        for end in offsets[ends].tolist():
            result.append(bytes(data[begin:end]))
            begin = end
        return result


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32)))


def _lists(lists: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ends) of at most CHUNK_IDS ids, but for a single longer list."""
    ids: list[np.ndarray] = []
    held = 0
    for own in lists:
        if ids and held + len(own) > CHUNK_IDS:
            yield np.concatenate(ids), np.cumsum([len(x) for x in ids])
            ids, held = [], 0
        ids.append(own)
        held += len(own)
    if ids:
        yield np.concatenate(ids), np.cumsum([len(x) for x in ids])


def _own(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each list of a column; null counts as empty."""
    return (value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int32) for value in column)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds array<int> `out` with the ids of each whole text. keep: the input's columns in the result (default: all)."""
    common.bound_batches(df.sparkSession)
    common.check_new(df, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            rows = batch.select(keep)
            for start, texts in common.chunks(batch.column(text), CHUNK_CHARS):
                part = rows.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_array(codec.encode(texts))], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds binary `out` with the bytes that each list of ids stands for."""
    common.bound_batches(df.sparkSession)
    common.check_new(df, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            rows, start = batch.select(keep), 0
            for flat, ends in _lists(_own(batch.column(ids))):
                part = rows.slice(start, len(ends))
                start += len(ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(flat, ends), pa.binary())], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def transcode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds binary `ids` with the ids of each whole text, as little-endian unsigned 32-bit integers, and binary `out` with the bytes that these stand for.

    Both are made in one worker, so a task has one codec; encode() and decode() behind each other have two.
    """
    common.bound_batches(df.sparkSession)
    common.check_new(df, ids, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.BinaryType(), False), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            rows = batch.select(keep)
            for start, texts in common.chunks(batch.column(text), CHUNK_CHARS):
                part, made = rows.slice(start, len(texts)), codec.encode(texts)
                decoded = [x for flat, ends in _lists(np.frombuffer(b, "<u4") for b in made) for x in codec.decode(flat, ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary()), pa.array(decoded, pa.binary())], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ids of every whole text of documents by the byte-level vocabulary, and their bytes decoded again."""
    import public_tokenizers as public

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = transcode(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
