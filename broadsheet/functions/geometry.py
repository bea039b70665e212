"""Geometry of boxes as Column expressions; null coordinates make comparisons false, as missing numbers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: Column | str) -> Column:
    """A double, null if the value is no number."""
    value = F.col(column) if isinstance(column, str) else column
    cast = value.try_cast("double")
    return F.when(~F.isnan(cast), cast)


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals over the shorter one's length."""
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / F.greatest(F.least(a2 - a1, b2 - b1), F.lit(1e-9))


def gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Distance of two intervals, 0 if they meet."""
    return F.greatest(b1 - a2, a1 - b2, F.lit(0.0))


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return width * height


def duplicates(a: Column, b: Column, iou: float = 0.85, contained: float = 0.95) -> Column:
    """Whether two boxes detect the same thing: they coincide, or one lies in the other."""
    both = intersection(a, b)
    own, other = F.greatest(area(a), F.lit(1e-9)), F.greatest(area(b), F.lit(1e-9))
    return holds((both > 0) & ((both / F.greatest(own + other - both, F.lit(1e-9)) >= iou) | (both / own >= contained) | (both / other >= contained)))


def ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1.0))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: int = 6, least: int = 8) -> Column:
    """Padded pixel box inside the page, null if a side is below `least`."""
    left, top = F.greatest(F.floor(x1).cast("int") - padding, F.lit(0)), F.greatest(F.floor(y1).cast("int") - padding, F.lit(0))
    right, bottom = F.least(F.ceil(x2).cast("int") + padding, width.cast("int")), F.least(F.ceil(y2).cast("int") + padding, height.cast("int"))
    return F.when((right - left >= least) & (bottom - top >= least), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))
