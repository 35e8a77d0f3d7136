"""Numeric scalar functions with one rounding rule: half up, by ``floor(x * 10^k + 0.5) / 10^k``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(c: Column, digits: int) -> Column:
    """Rounded half up; null stays null."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def percent(hit: Column, lines: Column) -> Column:
    """Share in percent to one decimal; 100 where there are no lines."""
    return F.when(lines == 0, F.lit(100.0)).otherwise(F.floor(F.lit(1000.0) * hit / lines + 0.5) / 10.0)


def ratio(num: Column, den: Column) -> Column:
    """Ratio to four decimals; 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(round_half(num.cast("double") / den, 4))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clamped to [0, 1]; 0 if either has no length, null if either is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size)))


def extent_length(extent: Column) -> Column:
    """Lines in ``a-b`` or ``a``; null if it is neither."""
    lo, hi = F.regexp_extract(extent, r"^(\d+)(?:-(\d+))?$", 1), F.regexp_extract(extent, r"^(\d+)(?:-(\d+))?$", 2)
    return F.when(lo != "", F.when(hi == "", F.lit(1)).otherwise(hi.try_cast("int") - lo.try_cast("int") + 1))


def id_order(c: Column) -> list[Column]:
    """Sort keys under which ``INV-2`` comes before ``INV-10``: text before the final number, then the number."""
    return [F.regexp_replace(c, r"\d+$", ""), F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("long"), F.lit(-1)), c]


def try_share(part: Column, known: Column) -> Column:
    """Percentage over what is known, to one decimal; null where nothing is known."""
    return F.when(known > 0, F.floor(F.lit(1000.0) * part / known + 0.5) / 10.0)
