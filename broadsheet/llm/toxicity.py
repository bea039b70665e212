"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel (Lodhi et al., 2002) compares two words by the subsequences of ORDER characters that they share, each weighted by DECAY
to the power of the stretch it spans, so characters put in or left out between cost weight but not the match. Documents are bags of
words: a bag's score is that of its worst word. Labels are of documents, so the words to learn from are proposed by
how much more often their parts occur in labelled toxic documents; they and words of clean documents, in a second round those
that the first machine finds worst, train the machine. As the machine is a sum over landmarks, it folds into one weight per
subsequence: the score of a word is exact and costs no kernel evaluation per landmark. A logistic curve makes it a probability.

The model is fitted on at most MAX_ROWS labelled rows of each label, chosen by a hash of the id; the driver gets at most MAX_WORDS words of each
kind and a score and a label of those rows.

Words are runs without white space, in lower case, end punctuation taken off, with marks where they begin and end; three or more single letters in a row also make a
word; a word of more than LONGEST characters counts as its overlapping windows. Defined results: null and empty texts, and texts without
words of three characters, get the score of a bag whose worst word shares nothing with any landmark. Without toxic or without clean
labels the score is the share of label 1, or 0.5 without labels. Repeated rows each have their score; other columns are never inputs.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 4
DECAY = 0.6
LONGEST = 20
#: Latin letters, and letters with accents that tell words apart; other accents are taken off (fixed values).
LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "éèêçñäöüßáíóúàùâîô"
#: Mark where a word begins and where it ends; parts of words are told apart by them.
BEGIN, END = "^$"
LETTERS = len(LATIN) + len(ACCENTED) + 5
LANDMARKS = 400
MAX_ROWS = 5_000
MAX_WORDS = 2_000
#: A part is suspect if it occurs in at least this many and this share of the toxic documents, and so many times as often there as in clean ones.
LEAST_DOCS = 3
LEAST_SHARE = 0.015
ODDS = 25.0
RIDGE = 0.02
SEED = 9
THRESHOLD = 0.7
CACHE_WORDS = 400_000


@lru_cache(1 << 12)
def _letter(c: str) -> int:
    """Number of a character: its place among the letters, or one number each for digits, other letters, all else and BEGIN."""
    known = LATIN + ACCENTED
    if c in known:
        return known.index(c)
    base = unicodedata.normalize("NFKD", c)[0]
    if base in LATIN:
        return LATIN.index(base)
    return len(known) + (0 if c.isdigit() else 1 if c.isalpha() else 3 if c == BEGIN else 4 if c == END else 2)


def _trim(token: str) -> str:
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


def tokens(text: str | None) -> set[str]:
    """Distinct raw tokens; words() makes words of them."""
    found = (text or "").lower().split()
    out = set(found)
    run: list[str] = []
    for t in [*(x if len(x) == 1 else "" for x in found), ""]:
        if t and t.isalpha():
            run.append(t)
            continue
        if len(run) > 2:
            out.add("".join(run))
        run = []
    return out


def words(token: str) -> list[str]:
    """The words that a token stands for: itself between BEGIN and END, or windows of that."""
    word = _trim(token)
    if len(word) + 1 < ORDER:
        return []
    word = BEGIN + word + END
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - step), step)]


def parts(word: str) -> set[str]:
    """Its first characters, and its runs of ORDER and of one more."""
    return {word[:k] for k in range(ORDER - 1, 2 * ORDER + 2) if k <= len(word) and word[0] == BEGIN} | {word[i : i + k] for k in (ORDER, ORDER + 1) for i in range(len(word) - k + 1)}


def gapped(word: str) -> list[str]:
    """A word with a character put in at two places, as insults are hidden."""
    return [word[:k] + c + word[k:] for k in sorted({3, len(word) // 2 + 1}) for c in "-x" if k < len(word)]


@lru_cache(64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(n), ORDER)), dtype=np.int64)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


def _codes(some: list[str]) -> np.ndarray:
    """Letters of words of one length."""
    return np.array([[_letter(c) for c in w] for w in some], dtype=np.int32).reshape(len(some), -1)


def _subsequences(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all subsequences, their weights) of words of one length."""
    places, weight = _places(letters.shape[1])
    code = letters[:, places[:, 0]]
    for k in range(1, ORDER):
        code = code * LETTERS + letters[:, places[:, k]]
    return code, weight


def _norm(letters: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself, by the kernel's recursion over pairs of places."""
    n = letters.shape[1]
    same = (letters[:, :, None] == letters[:, None, :]).astype(np.float32)
    reach = np.triu(DECAY ** np.maximum(np.arange(n)[None, :] - np.arange(n)[:, None] - 1, 0).astype(np.float32), 1).astype(np.float32)
    state = same * np.float32(DECAY**2)
    for _ in range(ORDER - 1):
        state = same * np.float32(DECAY**2) * (reach.T @ state @ reach)
    return np.sqrt(state.sum((1, 2)))


def by_length(some: list[str], size: int = 2048) -> Iterator[tuple[list[int], np.ndarray]]:
    """(indices, letters) of words of one length, few at a time."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        lengths.setdefault(len(w), []).append(i)
    for n, at in lengths.items():
        step = max(1, size * 200 // max(200, math.comb(n, ORDER)))
        for k in range(0, len(at), step):
            yield at[k : k + step], _codes([some[i] for i in at[k : k + step]])


class Landmarks:
    """Subsequence weights of the landmark words, unit length each."""

    def __init__(self, chosen: list[str]):
        found: dict[int, dict[int, float]] = {}
        for at, letters in by_length(chosen):
            code, weight = _subsequences(letters)
            norm = _norm(letters)
            for row, i in enumerate(at):
                for c, w in zip(code[row].tolist(), weight.tolist()):
                    own = found.setdefault(c, {})
                    own[i] = own.get(i, 0.0) + w / norm[row]
        self.row = np.zeros(LETTERS**ORDER, np.int32)
        self.weights = np.zeros((len(found) + 1, len(chosen)), np.float32)
        for k, (c, own) in enumerate(found.items(), 1):
            self.row[c] = k
            for i, w in own.items():
                self.weights[k, i] = w

    def kernel(self, some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), self.weights.shape[1]), np.float32)
        for at, letters in by_length(some, 128):
            code, weight = _subsequences(letters)
            rows = self.row[code]
            for k, i in enumerate(at):
                hit = np.flatnonzero(rows[k])
                out[i] = weight[hit] @ self.weights[rows[k][hit]]
            out[at] /= _norm(letters)[:, None]
        return out


@dataclass
class Model:
    """Weights of subsequences, offset, and the logistic curve of a bag's worst word."""

    weight_of: np.ndarray | None
    offset: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)
    share: float | None = None
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        if self.weight_of is None:
            return self.__dict__ | {"known": {}}
        at = np.flatnonzero(self.weight_of)
        return self.__dict__ | {"known": {}, "weight_of": (at, self.weight_of[at])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if state["weight_of"] is not None:
            at, weight = state["weight_of"]
            self.weight_of = np.zeros(LETTERS**ORDER, np.float32)
            self.weight_of[at] = weight

    def word_scores(self, some: list[str]) -> np.ndarray:
        out = np.full(len(some), self.offset)
        for at, letters in by_length(some):
            code, weight = _subsequences(letters)
            out[at] = self.offset + (self.weight_of[code] @ weight) / _norm(letters)
        return out

    def learn(self, new: list[str]) -> None:
        """Remembers the scores of tokens."""
        parts = [words(t) for t in new]
        flat = sorted({w for p in parts for w in p})
        score = dict(zip(flat, self.word_scores(flat).tolist()))
        for token, p in zip(new, parts):
            self.known[token] = max((score[w] for w in p), default=self.offset)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Scores of the two worst words of each text."""
        bags = [tokens(t) for t in texts]
        new = set().union(*bags) if bags else set()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
        else:
            new.difference_update(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return np.array([heapq.nlargest(2, [self.offset, self.offset, *map(get, bag)]) for bag in bags]).reshape(-1, 2)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(worst), self.share)
        return 1 / (1 + np.exp(-np.clip(worst @ np.array(self.curve[:2]) + self.curve[2], -30, 30)))


def _machine(positive: dict[str, int], negative: dict[str, int]) -> tuple[np.ndarray, float]:
    """(weight of each subsequence, offset) of a squared-hinge machine on Nyström features; words with their counts, the telling ones first."""
    marks = Landmarks(list(positive)[: LANDMARKS // 2] + list(negative)[: LANDMARKS // 2])
    some = [*positive, *negative]
    k = marks.kernel(some).astype(np.float64)
    m = marks.weights.T.astype(np.float64) @ marks.weights.astype(np.float64)
    value, vector = np.linalg.eigh(m)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.hstack([k @ root, np.ones((len(some), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    count = np.sqrt([*positive.values(), *negative.values()])
    cost = np.where(y > 0, 0.5 * count / count[y > 0].sum(), 0.5 * count / count[y < 0].sum())
    penalty = np.eye(x.shape[1]) * RIDGE / x.shape[1]
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(50):
        xa = x[active]
        w = np.linalg.solve(xa.T @ (xa * cost[active, None]) + penalty, xa.T @ (cost[active] * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    folded = marks.weights.astype(np.float64) @ (root @ w[:-1])
    return folded[marks.row].astype(np.float32), float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slopes of the two worst words and shift by Newton steps, labels drawn in a little (Platt); a slope below 0 is left out."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    used = [0, 1]
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(len(w)), z.T @ (target - p) - 1e-3 * w)
            w += np.clip(step, -2, 2)
            if abs(step).max() < 1e-8:
                break
        if len(used) == 1 or min(w[:2]) >= 0:
            slopes = [0.0, 0.0]
            for k, v in zip(used, w):
                slopes[k] = float(v)
            return slopes[0], slopes[1], float(w[-1])
        used = [int(np.argmax(w[:2]))]


def _sample(labels: DataFrame, column: str, learn, id_col: str, max_rows: int) -> DataFrame:
    rows = labels.filter(learn & F.col(column).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(column).cast("int").alias("label"))
    n = dict(rows.groupBy("label").count().collect())
    limit = F.lit(0)
    for label, count in n.items():
        limit = F.when(F.col("label") == label, F.lit(min(1 << 30, int(max_rows / count * (1 << 30))))).otherwise(limit)
    return rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < limit)


def _parts(rows: DataFrame) -> DataFrame:
    """(part, whole word or not, label) for each document's distinct words and their parts of ORDER characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                own = {w for token in tokens(t.as_py()) for w in words(token)}
                grams = set().union(*map(parts, own))
                for some, whole in ((own, True), (grams, False)):
                    out[0].extend(some)
                    out[1].extend([whole] * len(some))
                    out[2].extend([label] * len(some))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int32())], names=["part", "whole", "label"])

    return rows.mapInArrow(run, "part string, whole boolean, label int")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", learn=None, id_col: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labelled rows of docs where `learn` (on labels) holds."""
    common.bound_batches(docs.sparkSession)
    chosen = _sample(labels, column, F.lit(True) if learn is None else learn, id_col, max_rows)
    rows = common.stash(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("label").alias("label")), "labelled")
    made = [rows]
    try:
        return _fit(rows, made)
    finally:
        common.drop_stash(*made)


def _fit(rows: DataFrame, made: list[DataFrame]) -> Model:
    """From (text, label); made gets what is written meanwhile."""
    n = dict(rows.groupBy("label").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(None, 0.0, share=n1 / (n1 + n0) if n1 + n0 else 0.5)
    counts = common.stash(_parts(rows).groupBy("whole", "part").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "parts")
    made.append(counts)
    odds = (F.col("toxic") + 0.5) / (n1 + 1.0) / ((F.col("clean") + 0.5) / (n0 + 1.0))
    suspects = counts.filter(~F.col("whole") & (F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * n1))).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    suspects = {r.part: r.odds for r in suspects.orderBy(F.desc("odds"), "part").limit(MAX_WORDS).collect()}
    wholes = counts.filter("whole")
    if not suspects:
        return Model(None, 0.0, share=n1 / (n1 + n0))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [max((suspects.get(x, 0.0) for x in parts(w)), default=0.0) for w in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("toxic"), pa.array(best)], names=["part", "toxic", "odds"])

    found = wholes.filter("toxic > 0 AND clean = 0").select("part", "toxic").mapInArrow(suspect, "part string, toxic bigint, odds double").filter("odds > 0")
    positive = {r.part: r.toxic for r in found.orderBy(F.desc(F.col("odds") * F.least("toxic", F.lit(20))), "part").limit(MAX_WORDS).collect()}
    # The first of them hidden as well, so the machine learns to see through a gap.
    positive |= {v: 1 for w in list(positive)[: MAX_WORDS // 8] for v in gapped(w) if v not in positive and len(v) <= LONGEST}
    clean = wholes.filter("clean > 0").select("part", "clean")
    negative = {r.part: r.clean for r in clean.orderBy(F.desc("clean"), "part").limit(MAX_WORDS // 2).collect()}
    negative |= {r.part: r.clean for r in clean.orderBy(F.xxhash64("part"), "part").limit(MAX_WORDS).collect()}
    if not positive or not negative:
        return Model(None, 0.0, share=n1 / (n1 + n0))
    for _ in range(2):
        model = Model(*_machine(positive, negative))

        def judge(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("clean"), pa.array(model.word_scores(batch.column("part").to_pylist()))], names=["part", "clean", "score"])

        worst = clean.mapInArrow(judge, "part string, clean bigint, score double").orderBy(F.desc("score"), "part").limit(MAX_WORDS)
        worst = {r.part: r.clean for r in worst.collect()}
        negative = worst | {k: v for k, v in negative.items() if k not in worst}
    model = Model(*_machine(positive, negative))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, model.worst(batch.column("text").to_pylist()).T), batch.column("label")], names=["first", "second", "label"])

    seen = rows.mapInArrow(bags, "first double, second double, label int").toPandas()
    model.curve = _logistic(seen[["first", "second"]].to_numpy(), seen["label"].to_numpy().astype(float))
    return model


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds double `out`, the probability that the whole text is toxic."""
    common.bound_batches(df.sparkSession)
    common.check_new(df, out)
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            worst = model.worst(texts) if model.share is None else np.zeros((len(texts), 2))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(model.probability(worst))], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.pmod(common.crc32_text(F.col(id_col)), F.lit(3)) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: toxicity of every whole text of documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), learn=~held_out())
    found = scored(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
