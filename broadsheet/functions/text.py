"""Text features of blocks as Column expressions; the sequence ratio alone needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no tokens for pair features, and for cluster validation.
STOPWORDS = "the and for with that this from are was were have has had not but you your his her their our its all can will one two new said page".split()
CLUSTER_STOPWORDS = "the and for that this with from into have has had was were are but not his her its their they them you your our out who said will would could should been being after before last also page turn nan".split()
ENTITY = r"\b[A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*){0,3}"
TERM = r"\b\w\w+\b"
KEYWORDS = 12


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalize(text: Column | str) -> Column:
    """White space as one space, trimmed, lower case; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " ")))


def _words(found: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(stop)))


def tokens(text: Column | str) -> Column:
    return _words(F.regexp_extract_all(normalize(text), F.lit("[a-z0-9]+"), F.lit(0)), STOPWORDS)


def keywords(text: Column | str, most: int = KEYWORDS) -> Column:
    """The longest tokens, then the first by alphabet."""
    ranked = F.array_sort(F.transform(tokens(text), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["w"])


def entities(text: Column | str) -> Column:
    """Normalised runs of up to four capitalised words."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("(?U)" + ENTITY), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda p: F.length(F.trim(p)) >= 3), normalize))


def cluster_tokens(text: Column | str) -> Column:
    return _words(F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0)), CLUSTER_STOPWORDS)


def terms(text: Column | str) -> Column:
    """Words of two characters and more, in order."""
    return F.regexp_extract_all(normalize(text), F.lit("(?U)" + TERM), F.lit(0))


def with_bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; two empty sets share nothing."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)])


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """Ratcliff and Obershelp's ratio of the normalised texts, 0 if either is empty; the order of the two matters."""
    return _ratio(normalize(left), normalize(right))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def short_hash(text: Column, n: int = 10) -> Column:
    return F.substring(F.md5(F.encode(text, "utf-8")), 1, n)


def hash_number(text: Column) -> Column:
    """The first 12 hexadecimal digits of the MD5 as a number."""
    return F.conv(short_hash(text, 12), 16, 10).cast("long")


def default_document_id(path: Column) -> Column:
    """Stem and path hash of a file."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("__", stem, short_hash(path))


def coerce_number(value: Column | str) -> Column:
    """struct(whole, real, text): a whole number, another number, or the text as it is; empty and null give nulls."""
    raw = F.nullif(_col(value), F.lit(""))
    real = raw.try_cast("double")
    whole = F.when((real == F.floor(real)) & (F.abs(real) < 9.0e18), real.cast("long"))
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), real).alias("real"), F.when(real.isNull(), raw).alias("text"))
