"""Vector functions on ``array`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))))[0]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def portable_bucket(term: Column, dim: int) -> Column:
    """A bucket from the first 32 bits of MD5, which every SQL engine can compute."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim
