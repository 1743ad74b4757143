"""Projection, time filters and views (PRJ1-3, FLT1-4, VIW1).

Filters compare the raw timestamp column with a typed literal, so the
predicate reaches the parquet scan (``PushedFilters``) and row groups
outside the range are skipped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, TimestampNTZType, TimestampType


def _ts_literal(df: DataFrame, ts: str, value: str | dt.datetime) -> Column:
    """A literal of the column's own timestamp type (no cast on the column)."""
    kind = df.schema[ts].dataType
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    if isinstance(kind, TimestampType):
        return F.expr(f"TIMESTAMP '{text}'")
    return F.lit(value)


def before(df: DataFrame, ts: str, t: str | dt.datetime) -> DataFrame:
    """Rows with ``ts < t`` (strict upper bound)."""
    return df.where(F.col(ts) < _ts_literal(df, ts, t))


def not_before(df: DataFrame, ts: str, t: str | dt.datetime) -> DataFrame:
    """Rows with ``ts >= t``."""
    return df.where(F.col(ts) >= _ts_literal(df, ts, t))


def after(df: DataFrame, ts: str, t: str | dt.datetime) -> DataFrame:
    """Rows with ``ts > t`` (strict lower bound)."""
    return df.where(F.col(ts) > _ts_literal(df, ts, t))


def between_half_open(df: DataFrame, ts: str, t0: str | dt.datetime, t1: str | dt.datetime) -> DataFrame:
    """Rows with ``t0 <= ts < t1``."""
    c = F.col(ts)
    return df.where((c >= _ts_literal(df, ts, t0)) & (c < _ts_literal(df, ts, t1)))


def filter_by(df: DataFrame, column: str) -> DataFrame:
    """Filter by a bare column; only a boolean column is a predicate.

    Anything else raises, as Spark does (``FILTER_NOT_BOOLEAN``), but
    before a job is planned.
    """
    kind = df.schema[column].dataType
    if not isinstance(kind, BooleanType):
        raise TypeError(f"filter column {column!r} is {kind.simpleString()}, not boolean")
    return df.where(F.col(column))


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Register (or replace) a temp view and return it for chaining."""
    df.createOrReplaceTempView(name)
    return df


def sql(df: DataFrame, query: str) -> DataFrame:
    """Run SQL against the session that owns ``df``."""
    return df.sparkSession.sql(query)
