"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Random strings get few characters per token from a vocabulary made for language. A run of TOKEN_RUN characters is a
random string if it has at most MAX_RATIO characters per token and is no known digest and no identifier, whatever characters it is made of.
Known digests: hexadecimal runs of a usual digest length (the `hex` pattern reports lowercase ones itself).
Identifiers: UUIDs, numbers, dates and version numbers, and words (by the same ratio) joined by separators or in camel case.

Spans are (kind, start, end) in code points, end exclusive, kinds in the order of KINDS. A random string that meets a span
of another kind is left out. Defined results: null and empty texts have no spans. Repeated rows each have their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

TOKEN_RUN = r"[A-Za-z0-9+/_=-]{20,}"
MAX_RATIO = 2.2
#: Least share of a name's letters that are in words.
WORDS = 0.6
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).finditer
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4)).finditer
_hex = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"]).finditer
_run = re.compile(TOKEN_RUN).finditer
_uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}").fullmatch
_digest = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch
_words = re.compile(r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+|[+/_=-]+").findall


def is_identifier(run: str, count_tokens) -> bool:
    """UUID, number with separators, or a name with at most two groups of digits of which WORDS of the letters are in words.

    A word has three letters or more, and more than MAX_RATIO of them per token in lower case.
    """
    if _uuid(run) or not re.search("[A-Za-z]", run):
        return True
    parts = [p for p in _words(run) if p[0].isalnum()]
    letters = [p for p in parts if not p.isdigit()]
    if len(parts) - len(letters) > 2:
        return False
    return sum(len(p) for p in letters if len(p) >= 3 and len(p) > MAX_RATIO * count_tokens(p.lower())) >= WORDS * sum(map(len, letters))


def is_random(run: str, count_tokens) -> bool:
    if _digest(run) and len(run) in DIGEST_LENGTHS or len(run) > MAX_RATIO * count_tokens(run):
        return False
    return not is_identifier(run, count_tokens)


def scan_text(text: str | None, count_tokens) -> list[tuple[str, int, int]]:
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in _assign(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _access(text)]
    found += [("hex", m.start(), m.end()) for m in _hex(text)]
    # Runs and spans of other kinds both come by their starts; `reach` is how far the spans that begin before a run's end go.
    base, at, reach = sorted((s, e) for _, s, e in found), 0, 0
    for m in _run(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and is_random(m.group(), count_tokens):
            found.append(("random", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class Counter:
    """Counts tokens of a vocabulary file; one per worker process and file."""

    held: dict[str, Counter] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> int:
        return len(self.encoding.encode_ordinary(run))

    @classmethod
    def of(cls, path: str, pattern: str) -> Counter:
        if path not in cls.held:
            cls.held[path] = cls(path, pattern)
        return cls.held[path]


def scan(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Adds array<struct<kind, start, end>> `out` with the secrets of each whole text, by start, then kind."""
    common.bound_batches(df.sparkSession)
    common.check_new(df, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, SPANS, False)])
    kind = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter.of(path, pattern)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t.as_py(), count)] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(found, kind)], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def redact(df: DataFrame, path: str, pattern: str, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span (overlapping ones as one) by `mark`; texts without spans stay as they are, null too."""
    common.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter.of(path, pattern)
        for batch in batches:
            texts = [redacted(t.as_py(), count, mark) for t in batch.column(text)]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def redacted(text: str | None, count, mark: str) -> str | None:
    spans = scan_text(text, count)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        _, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            end = max(end, spans[i + 1][2])
            i += 1
        out += [text[at:start], mark]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: secrets of every whole text of documents."""
    import public_tokenizers as public

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, keep=["doc_id"])

    def joined(kinds: tuple[str, ...]):
        some = F.filter("spans", lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def n(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), n("random"), F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
