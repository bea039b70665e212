"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document's whole text gives STATISTICS: shares of character groups and of repeated words and lines. Standardised, they are mapped
to random Fourier features that approximate a Gaussian kernel (Rahimi and Recht, 2007). Partitions sum up their part of the
normal equations, whose solution is the ridge score; pool-adjacent-violators on labelled rows left out of the equations turns scores
into probabilities.

The model is fitted on at most MAX_ROWS labelled rows, chosen by a hash of the id, in at most FIT_PARTITIONS partitions; so what
the driver gets is bounded: FIT_PARTITIONS matrices of FEATURES squared, and a score and a label of the calibration rows.

Defined results: null text counts as empty and gets a score like any other. Labels that are null are left out; with several labels
of an id the smallest counts. With no labels, or labels of one kind only, the score is the share of label 1, or 0.5 without any. Repeated
rows each have their score. Other columns are kept by `scored` and are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_ROWS = 40_000
FIT_PARTITIONS = 16
FEATURES = 256
RIDGE = 1e-3
SEED = 20
#: Kernel width in units of the standardised statistics' typical distance.
WIDTH = 1.0
#: One labelled row in so many is for calibration.
CALIBRATION = 4
THRESHOLD = 0.3

_GROUPS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"!", b"?", b"|", b"#$%&*@^~", b".", b",", b"\"'`", b"()[]{}<>", b"+=/\\_-:;", b" \t", b"\n\r", range(0, 9)]
_GROUP_OF = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _GROUP_OF[list(_g), _i] = 1.0


def statistics(text: str | None) -> list[float]:
    """Shares of character groups, and figures of words and lines, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUP_OF / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words))
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = sum(x[-1:] in (b".", b"!", b"?") for x in lines)
    longest = max(map(len, words), default=0)
    upper = sum(map(bytes.isupper, words))
    return [*shares.tolist(), math.log(n), n / w, math.log(w), distinct / math.sqrt(w), distinct / w, pairs / w, adjacent / w, len(set(lines)) / k, ends / k, math.log(n / k), math.log1p(longest), upper / w]


STATISTICS = len(_GROUPS) + 12


@dataclass(frozen=True)
class Model:
    """Statistics -> score between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    solution: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.weights + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        # Sums of a product depend on a row's place in the batch in the last digits; equal texts shall have equal scores.
        return np.interp(np.round(self.features(x) @ self.solution, 9), self.knots, self.values)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit (pool adjacent violators); each pool has one pseudo-count."""
    order = np.argsort(raw, kind="stable")
    prior = float(label.mean())
    pools: list[list[float]] = []  # sum of labels, weight, sum of scores
    for r, y in zip(raw[order].tolist(), label[order].tolist()):
        pools.append([y, 1.0, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    knots = np.array([r / n for _, n, r in pools])
    values = np.maximum.accumulate(np.array([(y + prior) / (n + 1) for y, n, _ in pools]))
    return knots, values


def sample(labels: DataFrame, column: str, learn, id_col: str, max_rows: int) -> DataFrame:
    """(id, label) of at most about max_rows rows where `learn` holds, chosen by a hash of the id."""
    rows = labels.filter(learn & F.col(column).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(column).cast("double").alias("label"))
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    return rows.select(F.col(id_col).alias("id"), "label")


def _arrays(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("statistics", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", learn=None, id_col: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labelled rows of docs where `learn` (on labels) holds."""
    common.bound_batches(docs.sparkSession)
    chosen = sample(labels, column, F.lit(True) if learn is None else learn, id_col, max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    made = common.stash(_arrays(rows, "text", ["id", "label"]), "statistics")
    try:
        return _fit(made.coalesce(FIT_PARTITIONS))
    finally:
        common.drop_stash(made)


def _fit(rows: DataFrame) -> Model:
    """From (id, label, statistics)."""
    width = STATISTICS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * width)
        for batch in batches:
            x, y = _matrix(batch), batch.column("label").to_numpy()
            total += np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    total = np.sum([r[0] for r in rows.mapInArrow(sums, "total array<double>").collect()] or [np.zeros(2 + 2 * width)], axis=0)
    n, ones = total[:2]
    mean = total[2 : 2 + width] / max(n, 1)
    scale = np.sqrt(np.maximum(total[2 + width :] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    weights = rng.standard_normal((width, FEATURES)) / (WIDTH * math.sqrt(width))
    phase = rng.uniform(0, 2 * math.pi, FEATURES)
    share = ones / n if n else 0.5
    flat = Model(mean, scale, weights, phase, np.zeros(FEATURES + 1), np.zeros(1), np.array([share]))
    if ones in (0, n):
        return flat

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = flat.features(_matrix(batch)), batch.column("label").to_numpy()
            left += z.T @ z
            right += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.append(left.ravel(), right).tolist()], pa.list_(pa.float64()))], names=["total"])

    apart = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(CALIBRATION)) == 0
    got = np.sum([r[0] for r in rows.filter(~apart).mapInArrow(equations, "total array<double>").collect()], axis=0)
    left, right = got[: -FEATURES - 1].reshape(FEATURES + 1, FEATURES + 1), got[-FEATURES - 1 :]
    solution = np.linalg.solve(left + RIDGE * n / FEATURES * np.eye(FEATURES + 1), right)
    raw = Model(mean, scale, weights, phase, solution, np.zeros(1), np.zeros(1))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(raw.features(_matrix(batch)) @ solution), batch.column("label")], names=["raw", "label"])

    left_out = rows.filter(apart).mapInArrow(scores, "raw double, label double").toPandas()
    if left_out["label"].nunique() < 2:
        left_out = rows.mapInArrow(scores, "raw double, label double").toPandas()
    knots, values = isotonic(left_out["raw"].to_numpy(), left_out["label"].to_numpy())
    return Model(mean, scale, weights, phase, solution, knots, values)


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds double `out`, the probability of label 1, of each whole text."""
    common.bound_batches(df.sparkSession)
    common.check_new(df, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(text)]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(model.score(x))], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(id_col="doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.pmod(common.crc32_text(F.col(id_col)), F.lit(5)) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: quality of every whole text of documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), learn=~held_out())
    found = scored(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
