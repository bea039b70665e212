"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its ids by a vocabulary file of the tokenizers library and then an end id; only documents longer than a sequence are cut, into
full pieces, with the remainder first. Pieces are dealt by a hash into groups of about GROUP pieces, and each group is packed
best-fit decreasing: the longest piece first, each into the open sequence with the least room that holds it, which a segment
tree over the remaining capacities finds in logarithmic time. A group ends with few sequences that are not full, so the
number of sequences is that of one packing of all pieces plus a few per GROUP pieces, and memory is bounded by the group.

Pieces are sorted inside a group by length, id and number, and come from a written table, so a task that runs again gives the same sequences.

Defined results: null text counts as empty, and an empty document is the end id alone. Repeated rows are packed each, in any group. Names of kept columns
that clash with the results' raise ValueError. No rows give no sequences. Special tokens' strings in a text get their special ids, as the tokenizer file has it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 2048
END = 0
GROUP = 250_000
#: Characters whose pieces go into one batch (a longer single text goes alone).
CHUNK_CHARS = 2_000_000


class Ids:
    """Ids as a byte-level tokenizers file gives them; one per worker process and file.

    The file's vocabulary and special tokens are read into tiktoken, which contracts the same pairs in the same order at a third of the time.
    """

    held: dict[str, Ids] = {}

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str, pattern: str) -> Ids:
        if path not in cls.held:
            cls.held[path] = cls(path, pattern)
        return cls.held[path]

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()


def cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first one if there is a remainder."""
    at = 0
    if n % length:
        at = n % length
        yield 0, at
    while at < n:
        yield at, length
        at += length


def pieces(df: DataFrame, path: str, pattern: str, length: int = LENGTH, end: int = END, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: the kept columns, piece, start, length, ids_crc32 and, on request, the ids themselves."""
    common.bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    own = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    spark_own = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        own.append(("ids", pa.list_(pa.int32())))
        spark_own.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    common.check_new(df.select(*keep), *(name for name, _ in own))
    schema = T.StructType([*(df.schema[c] for c in keep), *spark_own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = Ids.of(path, pattern), int(end).to_bytes(4, "little")
        for batch in batches:
            kept = batch.select(keep)
            for first, texts in common.chunks(batch.column(text), CHUNK_CHARS):
                made, row = {name: [] for name, _ in own}, []
                for i, t in enumerate(texts, first):
                    raw = ids(t) + last
                    for k, (start, n) in enumerate(cut(len(raw) // 4, length)):
                        part = raw[4 * start : 4 * (start + n)]
                        row.append(i)
                        for name, value in (("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(part))):
                            made[name].append(value)
                        if with_ids:
                            made["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(row, pa.int64())).columns, *(pa.array(made[name], kind) for name, kind in own)], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


class Rooms:
    """Segment tree over remaining capacities: how many open sequences have each room, and the least room that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int) -> int:
        at = self.leaves + room
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[room].pop()

    def least(self, need: int) -> int:
        """The least room of at least `need` that is open, or -1."""
        count, at = self.count, self.leaves + need
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of pieces that come by decreasing length."""
    rooms, sequences, offsets, opened = Rooms(length), [], [], 0
    for n in lengths:
        room = rooms.least(n)
        if room < 0:
            sequence, room = opened, length
            opened += 1
        else:
            sequence = rooms.take(room)
        sequences.append(sequence)
        offsets.append(length - room)
        if room > n:
            rooms.add(room - n, sequence)
    return sequences, offsets


def place(df: DataFrame, rows: int, id_col: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the `rows` pieces of df, a table whose rows keep their places."""
    n = max(1, math.ceil(rows / group))
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    common.check_new(df, "sequence_id", "offset")
    # The row's place in the table spreads rows that are equal in all else.
    (row,) = common.fresh_name(df, "row")
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartition(n, F.xxhash64(id_col, "piece", "start", "ids_crc32", row))
    dealt = dealt.sortWithinPartitions(F.desc("length"), id_col, "piece", "ids_crc32", row).drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        lengths = [x for batch in held for x in batch.column("length").to_pylist()]
        sequences, offsets = best_fit(lengths, length)
        first, at = TaskContext.get().partitionId() << 40, 0
        for batch in held:
            to = at + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + s for s in sequences[at:to]], pa.int64()), pa.array(offsets[at:to], pa.int64())], names=schema.names)
            at = to

    return dealt.mapInArrow(run, schema)


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Tokenises, cuts and packs: one row per piece."""
    made = common.stash(pieces(df, path, pattern, length, text=text, keep=[id_col]), "pieces")
    return place(made, made.count(), id_col, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers as public

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public.path("byte_bpe_50k.json"), public.PATTERN)
