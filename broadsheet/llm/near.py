"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal sets form a class; only classes go on.
The sketch (Dahlgaard, Knudsen and Thorup, 2017) fills its coordinates in rounds: a round hashes each element to a coordinate
and a value, later rounds have larger values, and after as many rounds as coordinates each further round is for one
coordinate alone, so each gets filled. Bands of coordinates are buckets; their number follows from MISS, the probability
that a pair just at the threshold shares no bucket. All links are confirmed on the full sets.

Large buckets are never turned into all their pairs. In each bucket the class with the most company in its buckets is the hub, and every
class is compared with its hubs. Components that this leaves apart can only be joined by two members of one bucket that share a token of their
prefixes, in an order of tokens that puts those first which the hub lacks; so members apart from their hub are joined with the hub's
members on such tokens, under the positional and size bounds, and these pairs are compared too. Every pair of a bucket is thus
compared, or cannot be similar, or is already in one component.

Defined results: null text, empty text and text without words have an empty set and are linked with nothing. With fewer words than a shingle
has, all words are one shingle. Ids may be of any type that can be ordered, negative numbers and strings too; a component has the smallest of its rows' ids.
Rows that share an id count as one document. A row with a null id can be joined to others but names no component, unless
there is no other id in it (component null). Texts of any length are compared whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

SHINGLE = 5
ROWS = 6
MISS = 1e-8
BUCKETS = 64

_EMPTY = np.iinfo(np.uint64).max


@dataclass(frozen=True)
class Rule:
    """Documents are linked if 100 * intersection >= percent * union of their sets."""

    percent: int = 80
    words: int = SHINGLE

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def least(self) -> int:
        """Smaller sets can only be linked with equal ones."""
        return math.ceil(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 62


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of A-Z lower-cased words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(acc)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch with `size` coordinates of a set that is not empty."""
    out = np.full(size, _EMPTY, np.uint64)
    n, at = len(elements), 0
    step = max(1, min(size, math.ceil(size * (math.log(size) + 1.5) / n)))
    while at < size:
        rounds = np.arange(at, min(size, at + step), dtype=np.uint64)
        seeds = _mix(rounds + np.uint64(1))
        h = _mix(elements[None, :] ^ seeds[:, None])
        place = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(48)) | (_mix(h) >> np.uint64(16))
        np.minimum.at(out, place.ravel(), value.ravel())
        if (out != _EMPTY).all():
            return out
        at += step
        step = max(1, min(step, 8192 // n))
    for place in np.flatnonzero(out == _EMPTY):
        turn = np.uint64(size + place)
        h = _mix(_mix(elements ^ _mix(np.array([turn + np.uint64(1)]))))
        out[place] = (turn << np.uint64(48)) | (h.min() >> np.uint64(16))
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of ROWS coordinates."""
    parts = coordinates.reshape(bands, ROWS)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return acc.view(np.int64)


def sketches(df: DataFrame, rule: Rule, id_col: str, text: str) -> DataFrame:
    """(id, n, digest of the set, keys of its bands) of each row; digest null for empty sets, no keys for sets below rule.least."""
    common.bound_batches(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType(), False))])
    bands = rule.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, digests, keys = [], [], []
                for t in batch.column(1):
                    own = shingle_set(t.as_py(), rule.words)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    keys.append(band_keys(sketch(own, bands * ROWS), bands) if len(own) >= rule.least else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"])

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(text) -> (digest, members): the digest of the full set, and the set as bytes; other columns are kept."""
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("own", T.BinaryType()), T.StructField("members", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        with np.errstate(over="ignore"):
            for batch in batches:
                made = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
                rows = batch.select([f.name for f in kept]).columns
                yield pa.RecordBatch.from_arrays([*rows, pa.array([xxhash.xxh3_128_digest(m) for m in made], pa.binary()), pa.array(made, pa.binary())], names=schema.names)

    return df.select(*(f.name for f in kept), "text").mapInArrow(run, schema)


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y, mine, other) -> (x, y) where the full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = len(b) - 1
                common_part = int((b[at] == a).sum())
                keep.append(100 * common_part >= percent * (len(a) + len(b) - common_part))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "x bigint, y bigint")


def groups(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, n (size of its set), component (smallest id reachable)."""
    rows = common.stash(sketches(df, rule, id_col, text), "sketches")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = common.stash(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    repeated = common.stash(rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id"), "repeated")
    shared = None
    if not repeated.isEmpty():
        mine = rows.join(repeated, "id").select("id", "digest").join(classes.select("digest", "class"), "digest").select("id", "class").distinct()
        shared = mine.join(mine.groupBy("id").agg(F.min("class").alias("y")), "id").filter("class <> y").select(F.col("class").alias("x"), "y")
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    roots = _components(docs, rule, classes, shared)
    found = classes.select("digest", "first_id", "class").join(roots, F.col("class") == F.col("x"), "left").select("digest", "first_id", F.coalesce("y", "class").alias("root"))
    named = found.join(found.groupBy("root").agg(F.min("first_id").alias("component")), "root").select("digest", "component")
    named = common.stash(named, "named")
    common.drop_stash(classes, repeated, roots)
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    out = common.stash(out.select(F.col("id").alias(id_col), "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component")), "groups")
    common.drop_stash(rows, named)
    return out


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """(hub, x, root, apart, n, own set, hub's set) -> a row for each token of x's prefix in the hub's order.

    In a hub's order the tokens that the hub lacks come first. Two sets that are similar enough share a token among their first
    n - ceil(percent * n / 100) + 1 tokens in any common order, and in this one the tokens that a whole group has come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, row, place, shared = [], [], [], []
            for i, (mine, other) in enumerate(zip(batch.column("mine"), batch.column("other"))):
                a, b = (np.frombuffer(side.as_buffer(), np.uint64) for side in (mine, other))
                n = len(a)
                at = np.searchsorted(b, a)
                at[at == len(b)] = len(b) - 1
                common_part = b[at] == a
                tokens = np.concatenate([a[~common_part], a[common_part]])[: n + (-percent * n) // 100 + 1]
                parts.append(tokens)
                row.append(np.full(len(tokens), i))
                place.append(np.arange(len(tokens)))
                shared.append(np.full(len(tokens), int(common_part.sum())))
            if parts:
                kept = batch.select(["hub", "x", "root", "apart", "n"]).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(np.concatenate(c).astype(np.uint64).view(np.int64)) for c in (parts, place, shared))], names=[*kept.schema.names, "token", "place", "shared"])

    return members.mapInArrow(run, "hub bigint, x bigint, root bigint, apart boolean, n bigint, token bigint, place bigint, shared bigint")


def _with_sets(pairs: DataFrame, sets: DataFrame, x: str, y: str) -> DataFrame:
    """Adds the full sets of x (mine) and y (other). Only pairs move to the bucketed table; a y of many pairs can be split."""
    right = sets.join(pairs.select(F.col(y).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(y), F.col("members").alias("other"))
    return pairs.join(sets.select(F.col("id").alias(x), F.col("members").alias("mine")), x).join(right.hint("merge"), y)


def _roots(state: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after the components that links join are one."""
    ends = links.join(state.select(F.col("id").alias("x"), F.col("root").alias("rx")), "x").join(state.select(F.col("id").alias("y"), F.col("root").alias("ry")), "y")
    moved = graph.components(ends.select(F.col("rx").alias("x"), F.col("ry").alias("y")))
    return common.stash(state.join(moved, F.col("root") == F.col("x"), "left").select("id", F.coalesce("y", "root").alias("root")), "state")


def _class_sets(docs: DataFrame, rule: Rule, classes: DataFrame) -> DataFrame:
    """(id, members): the full set of each class (class, digest, first_id), from the text of a row of it."""
    own = F.col("own") == F.col("digest")
    named = docs.join(classes.select(F.col("first_id").alias("id"), "class", "digest"), "id").drop("id")
    made = _sets(named, rule.words).filter(own).select(F.col("class").alias("id"), "members")
    nameless = classes.filter("first_id IS NULL")
    if not nameless.isEmpty():
        other = _sets(docs.filter("id IS NULL").select("text"), rule.words).join(nameless.select("digest", "class"), own)
        made = made.unionByName(other.select(F.col("class").alias("id"), "members"))
    return made


def _components(docs: DataFrame, rule: Rule, classes: DataFrame, shared: DataFrame | None) -> DataFrame:
    """(x, y): the component y of class x, for classes that are joined to a smaller one; shared: further links (x, y), of rows that share an id."""
    spark, percent = docs.sparkSession, rule.percent
    keyed = classes.select(F.col("class").alias("id"), "n", F.explode("keys").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = common.stash(keyed.join(crowded, "bucket"), "members")
    company = members.groupBy("id").agg(F.sum("held").alias("company"))
    state = common.stash(company.select("id", F.col("id").alias("root")), "state")
    name = f"near_sets_{uuid.uuid4().hex}"
    made = _class_sets(docs, rule, classes.join(state.select(F.col("id").alias("class")), "class", "left_semi"))
    if shared is not None or not classes.filter("first_id IS NULL").isEmpty():
        # Several rows may have had the text of a class.
        made = made.dropDuplicates(["id"])
    made.write.bucketBy(BUCKETS, "id").sortBy("id").format("parquet").saveAsTable(name)
    sets = spark.table(name)
    try:
        hubs = members.join(company, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n"), F.struct("company", "id")).alias("hub"))
        pairs = members.join(hubs.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "bucket").filter("id <> hub")
        pairs = common.stash(pairs.select("hub", F.col("id").alias("x"), "n", "hub_n").distinct(), "pairs")
        similar_size = F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")
        first = pairs.filter(similar_size).select("x", F.col("hub").alias("y"))
        links = common.stash(_linked(_with_sets(first, sets, "x", "y").select("x", "y", "mine", "other"), percent), "linked")
        before, state = state, _roots(state, links)

        rooted = pairs.select("hub", "x", "n").join(state.select(F.col("id").alias("x"), "root"), "x").join(state.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub")
        rooted = rooted.select("hub", "x", "n", "root", (F.col("root") != F.col("hub_root")).alias("apart"))
        open_hubs = rooted.groupBy("hub").agg(F.count(F.lit(1)).alias("held"), F.max("apart").alias("any_apart"), F.min("root").alias("a"), F.max("root").alias("b")).filter("any_apart AND held > 1 AND a <> b")
        rooted = common.stash(rooted.join(open_hubs.select("hub"), "hub", "left_semi"), "open")
        every = common.stash(_prefixes(_with_sets(rooted, sets, "x", "hub"), percent), "tokens")
        # Only where members of several components share a token.
        mixed = every.groupBy("hub", "token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("apart").alias("any_apart")).filter("any_apart AND a <> b")
        tokens = every.join(mixed.select("hub", "token"), ["hub", "token"], "left_semi")
        left = tokens.filter("apart")
        right = tokens.select("hub", "token", *(F.col(c).alias(f"{c}_y") for c in ("x", "root", "apart", "n", "place", "shared")))
        rest = F.least(F.col("n") - F.col("place"), F.col("n_y") - F.col("place_y"))
        most = F.least("shared", "shared_y") + F.least(F.col("n") - F.col("shared"), F.col("n_y") - F.col("shared_y"))
        enough = F.lit(100 + percent) * F.least(rest, most) >= F.lit(percent) * (F.col("n") + F.col("n_y"))
        met = left.join(right, ["hub", "token"]).filter((F.col("root") != F.col("root_y")) & (~F.col("apart_y") | (F.col("x") < F.col("x_y"))) & enough)
        second = common.stash(met.select(F.least("x", "x_y").alias("x"), F.greatest("x", "x_y").alias("y")).distinct(), "pairs")
        more = common.stash(_linked(_with_sets(second, sets, "x", "y").select("x", "y", "mine", "other"), percent), "linked")
        between, state = state, _roots(state, more)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    common.drop_stash(members, pairs, links, rooted, every, second, more, before, between)
    joined = state.filter("id <> root").select(F.col("id").alias("x"), F.col("root").alias("y"))
    found = common.stash(joined, "roots") if shared is None else graph.components(joined.unionByName(shared))
    common.drop_stash(state)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: near-duplicate components of all documents at 85 of 100."""
    found = groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(85))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (first(na.n) + first(nb.n) - count(*))
), reach AS (
  SELECT x, x AS y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
), root AS (
  SELECT x, min(y) AS y FROM reach GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.y, w.doc_id) AS component_id, coalesce(root.y, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN root ON root.x = w.doc_id
"""
