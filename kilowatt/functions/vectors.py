"""Array/vector helpers kept on the JVM side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_vector(arr: Column | str) -> Column:
    """array<float|double> -> dense ml Vector (doubles)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return array_to_vector(a)


def to_array(vec: Column | str) -> Column:
    """ml Vector (dense or sparse) -> array<double>."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(v)


def squared_distance(a: Column, b: Column) -> Column:
    """sum_i (a[i] - b[i])^2 of two equal-length double arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def nearest_of(x: Column, centers: Column) -> Column:
    """(d, c) of the nearest of ``centers`` (an array of (cluster, center)) to the
    array ``x``: least squared distance, then least cluster; null without any."""
    return F.array_min(F.transform(centers, lambda s: F.struct(squared_distance(x, s["center"]).alias("d"), s["cluster"].alias("c"))))
