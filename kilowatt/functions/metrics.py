"""Aggregate expressions for regression metrics (one pass, partial aggs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regression_sums(label: str, prediction: str) -> list[Column]:
    """Sufficient statistics: n, sum err^2, sum |err|, sum y, sum y^2.

    All are algebraic aggregates, so Spark combines them map-side and
    only one small row per partition crosses the shuffle.
    """
    y = F.col(label).cast("double")
    err = y - F.col(prediction).cast("double")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("sse"),
        F.sum(F.abs(err)).alias("sae"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
    ]


def metrics_from_sums() -> list[Column]:
    """rmse, mse, r2, mae from the columns of :func:`regression_sums`.

    Undefined values are null, not errors: all four for an empty input, r2
    for a constant label (zero total sum of squares).
    """
    n, sse, sae, sy, syy = (F.col(c) for c in ("n", "sse", "sae", "sy", "syy"))
    nd = n.cast("double")
    sst = syy - F.try_divide(sy * sy, nd)
    return [
        F.sqrt(F.try_divide(sse, nd)).alias("rmse"),
        F.try_divide(sse, nd).alias("mse"),
        (F.lit(1.0) - F.try_divide(sse, F.when(sst != 0, sst))).alias("r2"),
        F.try_divide(sae, nd).alias("mae"),
    ]
