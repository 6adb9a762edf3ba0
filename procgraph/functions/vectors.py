"""Vector expressions in double precision (V2, V6, V8, V13); they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    """V2/V6: unit length in double precision; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def cosine(a: Column, b: Column) -> Column:
    """V8: 0 where a vector is missing, of another length, tiny or not finite."""
    s = dot(a, b) / (norm(a) * norm(b))
    good = (norm(a) >= 1e-12) & (norm(b) >= 1e-12) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(good & ~F.isnan(s), s), F.lit(0.0))
