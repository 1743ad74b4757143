"""Splits: random, by time, by key, and fold assignment (SPL1-4).

Deterministic splits are column expressions, so a split is a filter on
the same scan, not a second copy of the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilowatt.operators.relational import _ts_literal, before, between_half_open


def draw(key: str | Sequence[str], seed: int, use: str = "split") -> Column:
    """A number in [0, 1) from the hash of the row's key and the seed; draws for
    different uses are independent. It belongs to the key, not to the place of the row: another partitioning,
    a retried task or another run gives the same number.
    """
    names = [key] if isinstance(key, str) else list(key)
    return F.pmod(F.xxhash64(F.lit(int(seed)), F.lit(use), *[F.col(k) for k in names]), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_split(df: DataFrame, weights: list[float], seed: int, key: str | Sequence[str]) -> list[DataFrame]:
    """Random parts by :func:`draw`; weights are normalised. Parts are disjoint
    and cover the input, rows with a null key included."""
    names = [f"part{i}" for i in range(len(weights))]
    part = "__part"
    labelled = with_random_split(df, weights, seed, key, names, out=part)
    return [labelled.where(F.col(part) == n).drop(part) for n in names]


def with_random_split(
    df: DataFrame, weights: list[float], seed: int, key: str | Sequence[str], names: list[str] | None = None,
    out: str = "split",
) -> DataFrame:
    """Label each row with a part name by :func:`draw` over its key.

    One pass, no repeated scans; the labels are disjoint and cover the
    input by construction.
    """
    if seed is None:
        raise ValueError("a seed is required for a repeatable split")
    total = float(sum(weights))
    names = names or [f"part{i}" for i in range(len(weights))]
    r = draw(key, seed)
    expr: Column | None = None
    upper = 0.0
    for name, w in zip(names[:-1], weights[:-1]):
        upper += w / total
        expr = F.when(r < upper, F.lit(name)) if expr is None else expr.when(r < upper, F.lit(name))
    last = F.lit(names[-1])
    return df.withColumn(out, last if expr is None else expr.otherwise(last))


def time_split(
    df: DataFrame, ts: str, t_test: str | dt.datetime, t_end: str | dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """Train ``ts < t_test``; test ``t_test <= ts < t_end``; later rows dropped."""
    return before(df, ts, t_test), between_half_open(df, ts, t_test, t_end)


def with_time_split(
    df: DataFrame, ts: str, t_test: str | dt.datetime, t_end: str | dt.datetime, out: str = "split"
) -> DataFrame:
    """The two sides of :func:`time_split` as one labelled frame."""
    c = F.col(ts)
    lo, hi = _ts_literal(df, ts, t_test), _ts_literal(df, ts, t_end)
    return df.where(c < hi).withColumn(out, F.when(c < lo, F.lit("train")).otherwise(F.lit("test")))


def key_bucket(key: str, buckets: int) -> Column:
    """``pmod(key, buckets)``; a null key is in the last bucket."""
    return F.coalesce(F.pmod(F.col(key), F.lit(int(buckets))), F.lit(int(buckets) - 1))


def key_split(df: DataFrame, key: str, buckets: int = 10, cut: int = 7) -> tuple[DataFrame, DataFrame]:
    """Train ``key_bucket < cut``, test the rest; stable for a key. The two
    sides cover the input: rows with a null key are in the last bucket."""
    b = key_bucket(key, buckets)
    return df.where(b < cut), df.where(b >= cut)


def with_key_split(df: DataFrame, key: str, buckets: int = 10, cut: int = 7, out: str = "split") -> DataFrame:
    """The two sides of :func:`key_split` as one labelled frame."""
    b = key_bucket(key, buckets)
    return df.withColumn(out, F.when(b < cut, F.lit("train")).otherwise(F.lit("test")))


def with_folds(df: DataFrame, k: int, key: str | Sequence[str], seed: int | None = None, out: str = "fold") -> DataFrame:
    """Fold id in ``[0, k)``: ``pmod(key, k)``, or with a seed from :func:`draw`
    over the key (columns of any type). Rows with a null key have a fold too."""
    if seed is None:
        fold = key_bucket(key if isinstance(key, str) else key[0], k)
    else:
        fold = F.floor(draw(key, seed, "fold") * int(k))
    return df.withColumn(out, fold.cast("int"))
