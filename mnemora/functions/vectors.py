"""Vector and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def guarded_cosine(query: Column, v: Column) -> Column:
    """Null for a zero query vector."""
    return F.when(norm(query) < 1e-10, None).otherwise(dot(query, v) / (norm(query) * norm(v) + 1e-10))


def clamped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """NaN and null count as lo."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.nanvl(x, F.lit(lo)), F.lit(lo))))


def unit_score(x: Column) -> Column:
    """x where it is a number in [0, 1], else null."""
    return F.when(~F.isnan(x) & x.between(0, 1), x)


def percent_delta(before: Column, after: Column) -> Column:
    """Null where something came from nothing."""
    return F.when(before == 0, F.when(after == 0, 0.0)).otherwise((after - before) / before * 100)
