"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's set holds its distinct words. A line goes if an earlier line (by document, then line number) has a set with Jaccard similarity
of SIMILAR or more, whether or not that one goes too. So of equal and similar lines the first stays.

1. Words are counted over all documents by BUCKETS hash buckets, so the table of their rarities has a fixed size.
2. A line becomes the sorted array of its words' keys: rarity, then hash. Lines with equal arrays are one class, whose first line
   stands for it; the others go. A line's key is its row's number, then its own, so keys are in the order of the lines.
3. Two similar sets of n and m words share a word among their n - ceil(s n) + 1 and m - ceil(s m) + 1 rarest (prefix filter); of the shorter one
   m - ceil(2s m / (1 + s)) + 1 will do. Classes that have a word in such prefixes meet under it, if their lengths are near (hash join by word and step of
   lengths). Each is held against the earlier ones (length, positional and signature filters), and the one most like it by its signature is its partner. Pairs are never written.
4. Each class is compared with its partner by their whole sets of words; it goes if they are similar. The few whose partner is
   not similar are compared with all earlier ones that pass the filters.

Words that over HOT classes have in their prefixes are found beforehand. Under such a word all are held against the first class, and all look for partners under two shared
words: similar sets share two among their first words, if one more is taken. Where two words have over HOT classes too, only
those unlike the first are held against the others. So a word, line or passage that very many lines have costs a few comparisons for each of them.

Defined results: null text stays null, lines without words always stay, texts keep their other lines and their order. Null ids come last; of rows
that share an id, or have none, the order is by a hash of the text, and equal rows count as one. No rows give no rows. All columns are kept, and extra ones are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIMILAR = 80
BUCKETS = 1 << 18
#: Rarities go by the logarithm of a count, in so many steps for each doubling.
STEPS = 2
#: Places in a word's queue up to which a class is held against all earlier ones there.
HOT = 1024
#: Rows of words that a task of the search for partners gets, or fewer.
TASK_ROWS = 1_000_000
#: Words above which a line has a signature of 256 bits, besides 128.
LONG = 96
SIGNATURE = ("bits0", "bits1", "bits2", "bits3")
#: Rows of words, or pairs, up to which one side of a join is broadcast: some 20 MB.
FEW = 200_000
#: Bits of a line's number in its key; row numbers have 32.
LINE_BITS = 31
#: Columns that tell rows apart, and in whose order they come.
ROW = ("null_id", "id", "hash", "hash2")


def _words(line: Column) -> Column:
    """Words between single characters of white space; two of them in a row have an empty word between them."""
    other = [F.contains(line, F.lit(c)) for c in "\t\x0b\x0c\r"]
    plain = F.when(reduce(Column.__or__, other), F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)
    return F.split(plain, " ")


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct words."""
    return F.array_except(F.transform(_words(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _bucket(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint"))


def _row(id_col: Column, text: Column) -> dict[str, Column]:
    """What tells rows apart and puts them in order: the id, and hashes of the whole text, of which rows without id have two."""
    return {"null_id": id_col.isNull(), "id": id_col, "hash": F.xxhash64(text), "hash2": F.when(id_col.isNull(), F.xxhash64(F.lit(1), text))}


def _same_row(row: dict[str, Column], names: dict[str, str]) -> Column:
    return reduce(Column.__and__, (row[c].eqNullSafe(F.col(names[c])) for c in ROW[1:]))


def numbered(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(number, text) of each row, with numbers from 0 in the rows' order; and ROW with the number, unless the ids themselves will do.

    Ids will do if they are whole numbers of 32 bits, none twice and none missing. Else the rows, without their texts, are sorted.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if isinstance(docs.schema["id"].dataType, T.IntegralType):
        n, unlike, low, high = docs.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        if n and n == unlike and low >= 0 and high < 1 << 32:
            return docs.select(F.col("id").cast("long").alias("number"), "text"), None
    rows = docs.select(*(c.alias(name) for name, c in _row(F.col("id"), F.col("text")).items())).distinct()
    # A partition's number, then a row's.
    at = common.stash(rows.orderBy(*ROW).withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33).cast("int")
    sizes = dict(at.groupBy(part.alias("part")).count().collect())
    before = [sum(sizes.get(k, 0) for k in range(p)) for p in range(max(sizes, default=0) + 1)]
    ranks = at.select(*ROW, (F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))
    ranks.stash_path = at.stash_path
    named = ranks.withColumnsRenamed({c: f"own_{c}" for c in ROW})
    row = _row(F.col("id"), F.col("text"))
    return docs.join(named, _same_row(row, {c: f"own_{c}" for c in ROW})).select("number", "text"), ranks


def rarities(docs: DataFrame) -> DataFrame:
    """(levels), a single row, written: the top byte of the keys of each bucket's words, higher for more frequent ones; words are counted over all lines of (number, text).

    The array never comes to the driver's Python nor, as numbers, into a plan, whose text the driver would keep for each query.
    """
    words = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_words(F.col("line"))).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # BUCKETS rows, whatever the input is.
    every = counts.unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("n"))).groupBy("bucket").agg(F.max("n").alias("n"))
    level = F.floor(F.log2(F.col("n") + 1) * STEPS)
    dealt = F.sort_array(F.collect_list(F.shiftleft("bucket", 8).bitwiseOR(level)))
    # A task's table of BUCKETS counts is larger than the quick one that Spark keeps by default.
    with common.settings(docs.sparkSession, spark__sql__codegen__aggregate__fastHashMap__capacityBit="19", spark__sql__codegen__aggregate__map__vectorized__enable="true"):
        return common.stash(every.agg(F.transform(dealt, lambda x: F.shiftleft(x.bitwiseAND(F.lit(255)), 56)).alias("levels")), "levels")


def _prefix(n: Column, similar: int) -> Column:
    """How many of a set's n words, the rarest first, hold one that any similar set has among its own first ones."""
    return n - F.ceil(n * F.lit(similar) / F.lit(100)).cast("int") + 1


def _index_prefix(n: Column, similar: int) -> Column:
    """As _prefix, against similar sets of as many words or more: two sets of n and m words share 2s / (1 + s) of the smaller one's words at least."""
    return n - F.ceil(n.cast("bigint") * F.lit(2 * similar) / F.lit(100 + similar)).cast("int") + 1


def _line_sets(docs: DataFrame, levels: DataFrame, similar: int) -> DataFrame:
    """(key, n, c1, c2, SIGNATURE, prefix, rare) of every line that has words.

    prefix: its rarest words as numbers of 31 bits, one more than _prefix says; none for sets that only equal ones are similar to. signature: one bit of 128 for
    each word, or of 256 in lines of over LONG words; the first 128 bits of these, together with the last, are the shorter signature. rare: how many words of the
    prefix, from the first on, are in HOT lines at most by the count of their bucket (one step less, as logarithms are rounded).
    """
    lines = docs.select("number", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    # Inside of functions over arrays a subquery may not be written, but the optimizer puts it there in place of its column.
    lines = lines.withColumn("levels", levels.select(F.transform("levels", lambda x: F.shiftright(x, 56).cast("tinyint")).alias("levels")).scalar())

    def key(h: Column) -> Column:
        # Where no key can be null, they are sorted as plain numbers.
        level = F.coalesce(F.get("levels", _bucket(h)), F.lit(0).cast("tinyint"))
        return F.shiftleft(level.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    keys = F.sort_array(F.transform(_hashes(F.col("words")), key))
    # The one-element array keeps the optimizer from working the keys out once for every use of theirs.
    sets = lines.select(F.shiftleft("number", LINE_BITS).bitwiseOR(F.col("line").cast("bigint")).alias("key"), keys.alias("keys"))
    sets = sets.select("key", F.explode(F.array("keys")).alias("keys")).filter(F.size("keys") > 0)
    n, least = F.size("keys"), -(-similar // (100 - similar)) if similar < 100 else (1 << 31) - 1
    first = F.slice("keys", 1, F.when(n >= least, _prefix(n, similar) + 1).otherwise(0))
    tokens = F.transform(first, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    often = max(math.floor(math.log2(HOT + 2) * STEPS) - 1, 0) << 56
    often = F.lit(often).cast("bigint")
    rare = F.when(F.get(first, F.size(first) - 1) < often, F.size(first)).otherwise(F.size(F.filter(first, lambda x: x < often)))

    def bits(part: int, parts: int) -> Column:
        # A word's bit from a table, so that little is worked out for each word.
        bit = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
        table = F.split(F.lit(",".join(map(str, [0] * 64 * part + bit + [0] * 64 * (parts - part - 1)))), ",").cast("array<bigint>")
        return F.aggregate("keys", F.lit(0).cast("bigint"), lambda some, x: some.bitwiseOR(F.get(table, x.bitwiseAND(F.lit(64 * parts - 1).cast("bigint")))))

    signature = [F.when(n > LONG, bits(k, 4)).otherwise(bits(k, 2) if k < 2 else F.lit(0)).alias(name) for k, name in enumerate(SIGNATURE)]
    return sets.select("key", n.alias("n"), F.xxhash64("keys").alias("c1"), F.xxhash64(F.lit(1), "keys").alias("c2"), *signature, tokens.alias("prefix"), rare.alias("rare"))


def _similar(n: Column, m: Column, overlap: Column, similar: int) -> Column:
    return F.lit(100 + similar) * overlap >= F.lit(similar) * (n + m)


def _count(a: str, b: str, combine) -> Column:
    """Number of bits that two signatures, begun by a and b, have combined: 256 of two long lines, else 128."""

    def bits(part: int, x: str) -> Column:
        return F.col(f"{x}{SIGNATURE[part]}")

    def short(part: int, x: str) -> Column:
        return bits(part, x).bitwiseOR(bits(part + 2, x))

    def total(parts, side) -> Column:
        return reduce(Column.__add__, (F.bit_count(combine(side(k, a), side(k, b))) for k in parts))

    long = F.shiftright(F.least(F.col(f"{a}size"), F.col(f"{b}size")), 32) > LONG
    return F.when(long, total(range(4), bits)).otherwise(total(range(2), short))


def _may_match(similar: int, a: str, b: str) -> Column:
    """Length, positional and signature filters for two sets that share a word; a and b begin the names of their columns.

    From the shared word on, if it is the first, least(n - place, m - place) words can be shared. A bit that only one set has is a word that only one has.
    """
    n, m = (F.shiftright(F.col(f"{x}size"), 32) for x in (a, b))
    place, other = (F.col(f"{x}size").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
    own, others = (_count(x, y, lambda p, q: p.bitwiseAND(F.bitwise_not(q))) for x, y in ((a, b), (b, a)))
    fits = F.lit(100) * F.least(n, m) >= F.lit(similar) * F.greatest(n, m)
    return fits & _similar(n, m, F.least(n - place, m - other), similar) & _similar(n, m, F.least(n - own, m - others), similar)


def _likeness(a: str, b: str) -> Column:
    """Share of the bits of two sets that both have."""
    return _count(a, b, Column.bitwiseAND) / _count(a, b, Column.bitwiseOR)


def _tokens(classes: DataFrame, similar: int) -> DataFrame:
    """(token, key, size, SIGNATURE): a row for each word of a class's prefix; size: how many words the class has, then the word's place."""
    n = F.col("n")
    some = classes.select("key", "n", *SIGNATURE, F.posexplode(F.slice("prefix", 1, _prefix(n, similar))).alias("place", "token"))
    return _whole(some.select("token", "key", F.shiftleft(n.cast("bigint"), 32).bitwiseOR(F.col("place").cast("bigint")).alias("size"), *SIGNATURE))


def _whole(tokens: DataFrame) -> DataFrame:
    """The same rows; as the optimizer need not add such a filter to one side of a join, all that read them can share an exchange."""
    return tokens.filter(" AND ".join(f"{c} IS NOT NULL" for c in tokens.columns))


def _pairs_of_tokens(classes: DataFrame, hot: DataFrame, similar: int) -> DataFrame:
    """As _tokens, for two words of a prefix of which the first is hot, a row of (first); the place is the one before the second's, so that the first counts too."""
    n = F.col("n")
    some = classes.select("key", "n", *SIGNATURE, "prefix", F.posexplode(F.slice("prefix", 1, _prefix(n, similar))).alias("place", "first"))
    some = some.join(hot, "first")
    some = some.select("key", "n", *SIGNATURE, "first", "place", F.posexplode(F.slice("prefix", F.col("place") + 2, F.size("prefix"))).alias("behind", "second"))
    return _whole(some.select(F.xxhash64("first", "second").alias("token"), "key", F.shiftleft(n.cast("bigint"), 32).bitwiseOR((F.col("place") + F.col("behind")).cast("bigint")).alias("size"), *SIGNATURE))


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("x").agg(F.max_by("y", "like").alias("y"), F.max("like").alias("like"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tokens' rows a and b of classes that share a token; the columns are not renamed, so that both sides can read one exchange."""
    return left.alias("a").join(right.alias("b"), F.col("a.token") == F.col("b.token")).filter(F.col("b.key") < F.col("a.key"))


def _queue(tokens: DataFrame) -> DataFrame:
    """Tokens' rows with their turn in the line under the token, the first class's columns there (begun by head_), and whether they may match it; without the first rows."""
    order = "over (partition by token order by key"
    head = {f"head_{c}": F.expr(f"first({c}) {order} rows between unbounded preceding and current row)") for c in ("key", "size", *SIGNATURE)}
    return tokens.select("*", F.expr(f"row_number() {order})").alias("turn"), *(c.alias(name) for name, c in head.items())).filter("turn > 1")


def _hot(tokens: DataFrame) -> DataFrame:
    """(hot): tokens that over HOT classes have, written."""
    return common.stash(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select(F.col("token").alias("hot")), "hot")


def _without(tokens: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    return tokens.join(F.broadcast(hot) if n_hot <= FEW else hot.hint("merge"), F.col("token") == F.col("hot"), "left_anti") if n_hot else tokens


def _partners(tokens: DataFrame, similar: int, rows: int) -> DataFrame:
    """(x, y, like), written: for classes x that may match an earlier class under a token of theirs, the one most like it. No token may be hot; rows: how many there are.

    Of two classes the longer one (of equally long ones the later) comes with its whole prefix, the other one with its first _index_prefix words, and twice: for its
    own step of lengths and for the next, of which one is the longer one's. Both sides read one exchange by token.
    """
    spark = tokens.sparkSession
    n, place = F.shiftright("size", 32).cast("int"), F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))
    # What cannot be null, or comes out of an outer explode, gets no filter from the optimizer, which would put it into one side's exchange.
    step = F.coalesce(F.floor(F.log(n) / F.lit(math.log(100 / similar * 1.0001))).cast("int"), F.lit(0))
    dealt = tokens.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS), "token")
    longer = dealt.select("*", step.alias("step"))
    shorter = dealt.select("*", F.explode_outer(F.when(place < _index_prefix(n, similar), F.array(step, step + 1))).alias("step"))
    met = longer.alias("a").join(shorter.hint("shuffle_hash").alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.step") == F.col("b.step")))
    n, m = (F.shiftright(F.col(f"{x}.size"), 32) for x in "ab")
    met = met.filter(((n > m) | ((n == m) & (F.col("a.key") > F.col("b.key")))) & _may_match(similar, "a.", "b."))
    found = _best(met.select(F.greatest("a.key", "b.key").alias("x"), F.least("a.key", "b.key").alias("y"), _likeness("a.", "b.").alias("like")))
    # Rows dealt by token are dealt by token and step, too.
    with common.settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return common.stash(found, "partners")


def _behind_heads(tokens: DataFrame, similar: int, further: bool) -> DataFrame:
    """As _partners, for tokens that very many classes have: all are held against the first, and `further` those unlike it against the other earlier ones."""
    queue = _queue(tokens)
    match = _may_match(similar, "", "head_") & (F.col("head_key") < F.col("key"))
    found = queue.filter(match).select(F.col("key").alias("x"), F.col("head_key").alias("y"), _likeness("", "head_").alias("like"))
    if further:
        met = _met(queue.filter(~match).select(*tokens.columns), tokens).filter(_may_match(similar, "a.", "b."))
        found = found.unionByName(met.select(F.col("a.key").alias("x"), F.col("b.key").alias("y"), _likeness("a.", "b.").alias("like")))
    return common.stash(_best(found), "partners")


def _all_partners(classes: DataFrame, similar: int) -> DataFrame:
    """(x, y): a partner for each class that may match an earlier one, written."""
    tokens = _tokens(classes, similar)
    rows = classes.agg(F.sum(_prefix(F.col("n"), similar).cast("bigint"))).first()[0] or 0
    common_words = F.slice("prefix", F.col("rare") + 1, F.greatest(_prefix(F.col("n"), similar) - F.col("rare"), F.lit(0)))
    hot = _hot(classes.select(F.explode(common_words).alias("token")))
    n_hot = hot.count()
    found, stashes = [_partners(_without(tokens, hot, n_hot), similar, rows)], [hot]
    if n_hot:
        of_two = _pairs_of_tokens(classes, hot.select(F.col("hot").alias("first")), similar)
        still = _hot(of_two)
        n_still = still.count()
        found += [_behind_heads(tokens.join(hot, F.col("token") == F.col("hot"), "left_semi"), similar, False), _partners(_without(of_two, still, n_still), similar, of_two.count())]
        stashes.append(still)
        if n_still:
            found.append(_behind_heads(of_two.join(still, F.col("token") == F.col("hot"), "left_semi"), similar, True))
    out = common.stash(reduce(DataFrame.unionByName, found).groupBy("x").agg(F.max_by("y", "like").alias("y")), "partners")
    common.drop_stash(*stashes, *found)
    return out


def _by_row(keys: DataFrame) -> DataFrame:
    """(key) -> (number, lines): bits of the lines' numbers, 64 to an entry of a map."""
    line = F.col("key").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), line.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright("key", LINE_BITS).alias("number"), F.shiftright(line, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits"))
    # At most as many entries as the text has lines, divided by 64.
    return words.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("lines"))


def _is_set(lines: Column, line: Column) -> Column:
    """Whether a line's bit is set in such a map, which may be null."""
    word = F.coalesce(F.try_element_at(lines, F.shiftright(line, 6)), F.lit(0).cast("bigint"))
    return F.call_function("shiftright", word, line.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _verified(docs: DataFrame, pairs: DataFrame, similar: int, few: bool = False) -> DataFrame:
    """Pairs (x, y) of keys of lines -> (x), each once, of those that are similar to some y by their whole sets of words. few: at most FEW pairs, so that the texts need not move."""
    wanted = _by_row(pairs.select(F.col("x").alias("key")).union(pairs.select("y")))
    wanted = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    lines = docs.join(wanted, "number").select("number", "lines", F.posexplode(F.split("text", "\n")).alias("line", "words")).filter(_is_set(F.col("lines"), F.col("line")))
    hashes = _hashes(F.col("words"))
    sets = common.stash(lines.select(F.shiftleft("number", LINE_BITS).bitwiseOR(F.col("line").cast("bigint")).alias("key"), hashes.alias("words")), "sets")
    both = pairs.select("x", "y").join(sets.select(F.col("key").alias("x"), F.col("words").alias("a")), "x").join(sets.select(F.col("key").alias("y"), F.col("words").alias("b")), "y")
    found = common.stash(both.filter(_similar(F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b")), similar)).select("x").distinct(), "gone")
    common.drop_stash(sets)
    return found


def _others(classes: DataFrame, failed: DataFrame, similar: int) -> DataFrame:
    """(x, y): all earlier classes that each failed class may match, but the one that it failed with.

    A pair comes once, under the first word that both prefixes have. A set shares no more words than the prefixes share and than one of them, the one that ends first, leaves behind.
    """
    n = F.col("n")
    words = F.slice("prefix", 1, _prefix(n, similar))

    def rows(some: DataFrame, *more: str) -> DataFrame:
        return some.select("key", "n", *SIGNATURE, *more, words.alias("words"), F.explode(words).alias("token")).withColumn("size", F.shiftleft(n.cast("bigint"), 32))

    left = common.stash(rows(classes.join(failed.select(F.col("x").alias("key"), F.col("y").alias("not_y")), "key"), "not_y"), "left")
    met = _met(F.broadcast(left) if left.count() <= FEW else left, rows(classes)).filter((F.col("b.key") != F.col("a.not_y")) & _may_match(similar, "a.", "b."))
    shared = F.array_intersect("a.words", "b.words")
    behind = F.greatest(F.col("a.n") - F.size("a.words"), F.col("b.n") - F.size("b.words"))
    met = met.filter((F.get(shared, F.lit(0)) == F.col("a.token")) & _similar(F.col("a.n"), F.col("b.n"), F.size(shared) + behind, similar))
    found = common.stash(met.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")), "others")
    common.drop_stash(left)
    return found


def removed_lines(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(number, text) -> (number, lines): the lines that go, as _by_row has them, for rows that lose any."""
    levels = rarities(docs)
    lines = common.stash(_line_sets(docs, levels, similar), "lines")
    common.drop_stash(levels)
    # Narrow rows are summed up; only then the first lines' columns come, once.
    heads = lines.groupBy("c1", "c2").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("head"))
    n = F.when(F.col("head"), F.col("n"))
    marked = common.stash(lines.drop("c1", "c2").join(heads.hint("shuffle_hash"), "key", "left").select("key", n.alias("n"), *(F.when(F.col("head"), F.col(c)).alias(c) for c in (*SIGNATURE, "prefix", "rare"))), "classes")
    common.drop_stash(lines)
    classes, same = marked.filter("n IS NOT NULL"), marked.filter("n IS NULL").select("key")
    long_enough = classes.filter(F.size("prefix") > 0)
    best = _all_partners(long_enough, similar)
    stashes = [marked, best]
    gone = _verified(docs, best, similar)
    failed = common.stash(best.join(gone, "x", "left_anti"), "failed")
    stashes += [gone, failed]
    found = same.unionByName(gone.select(F.col("x").alias("key")))
    if not failed.isEmpty():
        others = _others(long_enough, failed, similar)
        late = _verified(docs, others, similar, others.count() <= FEW)
        stashes += [others, late]
        found = found.unionByName(late.select(F.col("x").alias("key")))
    out = common.stash(_by_row(found), "removed")
    common.drop_stash(*stashes)
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """df with the later matches among its lines taken out of `text`, and n_lines, n_removed of each text."""
    common.check_new(df, "n_lines", "n_removed")
    number, lost, *own = common.fresh_name(df, "removed_number", "removed_lines", *(f"removed_{c}" for c in ROW))
    docs, ranks = numbered(df, id_col, text)
    removed = removed_lines(docs, similar).select(F.col("number").alias(number), F.col("lines").alias(lost))
    if ranks is None:
        joined = df.join(removed.hint("shuffle_hash"), F.col(id_col) == F.col(number), "left")
    else:
        by_row = removed.join(ranks.select(F.col("number").alias(number), *(F.col(c).alias(name) for c, name in zip(ROW, own))), number)
        joined = df.join(by_row.hint("merge"), _same_row(_row(F.col(id_col), F.col(text)), dict(zip(ROW, own))), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~_is_set(F.col(lost), i)), "\n")
    n_lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
    n_removed = F.aggregate(F.map_values(lost), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits))
    counted = joined.withColumns({"n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n_lines).cast("long"), "n_removed": F.coalesce(n_removed, F.lit(0)).cast("long")})
    return counted.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept)).drop(number, lost, *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents without the later matches among their lines."""
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(s))) AS line, unnest(s) AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), w AS (
  SELECT doc_id, line, list_distinct(list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l
), c AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS k, doc_id, line, words, len(words) AS n FROM w WHERE len(words) > 0
), s AS (
  SELECT list_sort(words) AS words, min(k) AS k, any_value(n) AS n FROM c GROUP BY 1
), t AS (
  SELECT k, n, unnest(words) AS word FROM s
), f AS (
  SELECT word, count(*) AS df FROM t GROUP BY 1
), p AS (
  SELECT k, n, word FROM (SELECT t.k, t.n, t.word, row_number() OVER (PARTITION BY t.k ORDER BY f.df, t.word) AS place FROM t JOIN f USING (word))
  WHERE place <= n - ceil(n * 80 / 100.0) + 1
), cand AS (
  SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b ON a.word = b.word AND b.k < a.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), hit AS (
  SELECT DISTINCT x FROM cand JOIN s a ON a.k = x JOIN s b ON b.k = y WHERE 180 * len(list_intersect(a.words, b.words)) >= 80 * (a.n + b.n)
), gone AS (
  SELECT c.doc_id, c.line FROM c LEFT JOIN (SELECT k FROM s WHERE k NOT IN (SELECT x FROM hit)) stay ON stay.k = c.k WHERE stay.k IS NULL
), kept AS (
  SELECT l.doc_id, string_agg(l.txt, chr(10) ORDER BY l.line) AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line WHERE g.line IS NULL GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(g.n, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = d.doc_id
"""
