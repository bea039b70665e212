"""Text features of candidate pairs.

The blocks of a newspaper, or of a page where no weights of terms are wanted, and its pairs come together once, so a text is moved once and not for each of its pairs
or terms. What is held at a time is a newspaper's texts and a few numbers for each of its words, as a newspaper's blocks are one corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ratio import Alphabet, Text, ratios

MOST_TERMS = 50_000


def as_is(df: DataFrame) -> DataFrame:
    return df


def distinct_blocks(blocks: DataFrame, order: str = "ord") -> DataFrame:
    """One row per block_id, the first by `order`."""
    return blocks.withColumn("_place", F.row_number().over(Window.partitionBy("block_id").orderBy(order))).filter("_place = 1").drop("_place")


def term_counts(blocks: DataFrame, bigrams: bool = True, most: int | None = MOST_TERMS, keep: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """(newspaper_id, block_id, term, n). most: of a newspaper's terms, the most frequent ones, the first by alphabet of equals, stay."""
    # The words get a column of their own first: a lambda would work them out again for each word.
    words = blocks.select("newspaper_id", "block_id", F.explode(F.array(X.terms("ocr_text"))).alias("words"))
    found = words.select("newspaper_id", "block_id", F.explode(X.with_bigrams(F.col("words")) if bigrams else "words").alias("term"))
    counts = found.groupBy("newspaper_id", "block_id", "term").agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counts
    counts = keep(counts)
    totals = counts.groupBy("newspaper_id", "term").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("newspaper_id").orderBy(F.desc("total"), "term"))
    kept = totals.withColumn("place", place).filter(F.col("place") <= most).select("newspaper_id", "term")
    return counts.join(kept, ["newspaper_id", "term"])


def tfidf(blocks: DataFrame, bigrams: bool = True, most: int | None = MOST_TERMS, keep: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """(newspaper_id, block_id, term, weight): counts by smoothed inverse document frequency, each block's weights of length 1.

    A newspaper's blocks are one corpus, blocks without text included. keep: writes what is read several times.
    """
    counts = keep(term_counts(blocks, bigrams, most, keep))
    size = blocks.groupBy("newspaper_id").agg(F.count(F.lit(1)).alias("blocks"))
    frequency = counts.groupBy("newspaper_id", "term").agg(F.count(F.lit(1)).alias("held"))
    idf = F.log((F.col("blocks") + 1) / (F.col("held") + 1)) + 1
    some = counts.join(frequency, ["newspaper_id", "term"]).join(size, "newspaper_id").withColumn("raw", F.col("n") * idf)
    norm = some.groupBy("newspaper_id", "block_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return some.join(norm, ["newspaper_id", "block_id"]).select("newspaper_id", "block_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def _cosines(words: pa.Array, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """The cosine of blocks left[k] and right[k] of one newspaper, 0 if they share no term. words: a block's words with spaces between, null without any.

    A term is a word or two words in a row, as a number: that of the first word's place in the alphabet, then of the second's. A space comes before all
    characters of words, so the numbers are in the order of the terms as texts.
    """
    n = len(words)
    lists = pc.split_pattern(words, " ")
    block = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    if not len(block):
        return np.zeros(len(left))
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    word = place[coded.indices.to_numpy()]
    next_to = block[1:] == block[:-1]
    terms, of = np.unique(np.concatenate([word << 32, ((word[:-1] << 32) | word[1:])[next_to]]), return_inverse=True)
    rows, counts = np.unique(np.concatenate([block, block[:-1][next_to]]) * len(terms) + of, return_counts=True)
    block, term = np.divmod(rows, len(terms))
    if len(terms) > most:
        totals = np.bincount(of, minlength=len(terms))
        kept = np.zeros(len(terms), bool)
        kept[np.argsort(-totals, kind="stable")[:most]] = True
        some = kept[term]
        block, term, counts = block[some], term[some], counts[some]
    weight = counts * (np.log((n + 1) / (np.bincount(term, minlength=len(terms)) + 1)) + 1)[term]
    weight /= np.sqrt(np.bincount(block, weight * weight, n))[block]
    begin = np.searchsorted(block, np.arange(n + 1))
    out, own, at = np.zeros(len(left)), np.zeros(len(terms)), -1
    for k in np.argsort(left, kind="stable"):
        if left[k] != at:
            if at >= 0:
                own[term[begin[at] : begin[at + 1]]] = 0
            at = left[k]
            own[term[begin[at] : begin[at + 1]]] = weight[begin[at] : begin[at + 1]]
        some = slice(begin[right[k]], begin[right[k] + 1])
        out[k] = own[term[some]] @ weight[some]
    return out


def _ratios(texts: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    alphabet = Alphabet()

    @lru_cache(TEXTS)
    def text(k: int) -> Text:
        return Text(texts[k].as_py() or "", alphabet)

    # Pairs with the same second text come together, as its places are listed once.
    order = np.lexsort((left, right))
    out = np.zeros(len(left))
    out[order] = np.fromiter(ratios((text(a), text(b)) for a, b in zip(left[order].tolist(), right[order].tolist())), float, len(left))
    return out


def _of_sets(lists: pa.Array, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """(shared members, all members) of each pair."""
    sets = [frozenset(x or ()) for x in lists.to_pylist()]
    for a, b in zip(left.tolist(), right.tolist()):
        shared = len(sets[a] & sets[b])
        yield shared, len(sets[a]) + len(sets[b]) - shared


#: Texts that are held with the places of their characters.
TEXTS = 256
_MADE = {"words": "ocr_cosine_similarity double", "text": "text_similarity double", "entities": "entity_overlap double", "keywords": "shared_keywords int"}


def _compared(pairs: DataFrame, blocks: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], most: int = MOST_TERMS, kept: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """(pair_id, a feature for each of the names) of every pair. A block without a row, as one without text, has no words, entities and keywords; of rows that share a block_id the first by `order` counts.
    kept: (keys, block_id, order) of the blocks that count; the others' texts are left out where they have come to, as joining moves texts once more.

    keys: the columns of newspapers or pages, whose pairs and blocks come together.
    """

    some_kept = kept is not None

    def compare(group: tuple[pa.Scalar, ...], pairs: pa.Table, blocks: pa.Table) -> pa.Table:
        if some_kept:
            ids = list(zip(blocks.column("block_id").to_pylist(), blocks.column(order).to_pylist()))
            here = blocks.column("here").to_pylist()
            wanted = {x for x, h in zip(ids, here) if h}
            blocks = blocks.filter(pa.array([not h and x in wanted for x, h in zip(ids, here)], pa.bool_()))
        blocks = blocks.take(pc.sort_indices(blocks, [(order, "ascending")], null_placement="at_start")).combine_chunks()
        place: dict[str | None, int] = {}
        for k, b in enumerate(blocks.column("block_id").to_pylist()):
            place.setdefault(b, k)
        blocks = blocks.take(pa.array(list(place.values()), pa.int64())).combine_chunks()
        number = {b: k for k, b in enumerate(place) if b is not None}
        ends = [np.array([number.get(b, -1) for b in pairs.column(f"{side}_block_id").to_pylist()], np.int64) for side in ("left", "right")]
        both = np.flatnonzero((ends[0] >= 0) & (ends[1] >= 0))
        left, right = ends[0][both], ends[1][both]
        # Rows of a newspaper without a name are no corpus.
        named = group[0].as_py() is not None

        def column(name: str) -> pa.Array:
            c = blocks.column(name)
            return c.chunk(0) if c.num_chunks else pa.array([], c.type)

        def made(name: str) -> pa.Array:
            out = np.zeros(len(ends[0]))
            if not len(both):
                pass
            elif name == "words":
                out[both] = _cosines(column("words"), left, right, most) if named else 0.0
                return pa.array(out, mask=out == 0)
            elif name == "text":
                out[both] = _ratios(column("text"), left, right)
            elif name == "entities":
                out[both] = [shared / max(every, 1) for shared, every in _of_sets(column("entities"), left, right)]
            else:
                out[both] = [shared for shared, _ in _of_sets(column("keywords"), left, right)]
            return pa.array(out.astype(np.int32) if name == "keywords" else out, mask=out == 0 if name == "words" else None)

        return pa.table([pairs.column("pair_id"), *map(made, names)], names=["pair_id", *(_MADE[x].split()[0] for x in names)])

    # The columns are made where texts have come to, so that they are not moved.
    own = {
        "words": F.nullif(F.array_join(X.terms("ocr_text"), " "), F.lit("")), "text": X.normalize("ocr_text"),
        "entities": X.entities("ocr_text"), "keywords": X.keywords("ocr_text"),
    }
    texts = blocks.select(*keys, "block_id", order, "ocr_text", F.lit(False).alias("here"))
    if kept is not None:
        texts = texts.union(kept.select(*keys, "block_id", order, F.lit(None).cast("string"), F.lit(True)))
    moved = texts.repartition(*keys).select(*keys, "block_id", order, "here", *(own[x].alias(x) for x in names))
    some = pairs.select(*keys, "pair_id", "left_block_id", "right_block_id")
    kind = some.schema["pair_id"].dataType.simpleString()
    return some.groupBy(*keys).cogroup(moved.groupBy(*keys)).applyInArrow(compare, f"pair_id {kind}, " + ", ".join(_MADE[x] for x in names))


def cosines(pairs: DataFrame, blocks: DataFrame, most: int = MOST_TERMS, kept: DataFrame | None = None) -> DataFrame:
    """(pair_id, ocr_cosine_similarity) for pairs that share a term."""
    return _compared(pairs, blocks, ("newspaper_id",), ("words",), most, kept).filter("ocr_cosine_similarity IS NOT NULL")


def sequence_ratios(pairs: DataFrame, blocks: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(pair_id, text_similarity) of every pair, with a page's pairs in one task."""
    return _compared(pairs, blocks, ("newspaper_id", "image_id"), ("text",), kept=kept)


def features(pairs: DataFrame, blocks: DataFrame, sequence: bool = True, most: int = MOST_TERMS, kept: DataFrame | None = None) -> DataFrame:
    """(pair_id, ocr_cosine_similarity, text_similarity, entity_overlap, shared_keywords) of every pair; blocks without a row have empty text.

    sequence: without it text_similarity is 0.
    """
    names = ("words", "text", "entities", "keywords") if sequence else ("words", "entities", "keywords")
    return _compared(pairs, blocks, ("newspaper_id",), names, most, kept).select(
        "pair_id",
        F.coalesce("ocr_cosine_similarity", F.lit(0.0)).alias("ocr_cosine_similarity"),
        F.col("text_similarity") if sequence else F.lit(0.0).alias("text_similarity"),
        "entity_overlap",
        "shared_keywords",
    )


def merge(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """Pairs with their text features; a pair without any has zeros."""
    names = ["ocr_cosine_similarity", "text_similarity", "entity_overlap", "shared_keywords"]
    return pairs.join(text.select("pair_id", *names), "pair_id", "left").na.fill(0.0, names[:3]).na.fill(0, names[3:])
