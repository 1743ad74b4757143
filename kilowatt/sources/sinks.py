"""Result sinks and reports (SNK1-SNK5)."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def write_pairs_text(
    df: DataFrame,
    path: str,
    key: str = "word",
    value: str = "count",
    num_files: int | None = None,
    mode: str = "errorifexists",
) -> str:
    """Write ``(key,value)`` lines as text, failing if ``path`` exists.

    The reference writes one file (one reducer). At scale the result of an
    aggregation can itself be large, so the default keeps the aggregation's
    partitions and writes in parallel; ``num_files=1`` reproduces the single
    file. ``coalesce`` merges partitions without another shuffle.
    """
    out = df.select(F.format_string("(%s,%s)", F.col(key), F.col(value)).alias("value"))
    if num_files:
        out = out.coalesce(num_files)
    out.write.mode(mode).text(path)
    return path


def read_pairs_text(spark: SparkSession, path: str, key: str = "word", value: str = "count") -> DataFrame:
    """Parse ``(key,value)`` lines back; the key may itself hold commas."""
    raw = spark.read.text(path)
    body = F.expr("substring(value, 2, length(value) - 2)")
    k = F.regexp_extract(body, r"^(.*),([^,]*)$", 1)
    v = F.regexp_extract(body, r"^(.*),([^,]*)$", 2).cast("long")
    return raw.select(k.alias(key), v.alias(value))


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (``show``), stable when ``order_by`` is given.

    ``orderBy(...).limit(n)`` plans as a distributed top-k, not a sort.
    """
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    """The schema as rows (column, type, nullable), instead of printing it."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column string, type string, nullable boolean")


def timed(fn: Callable[[], T]) -> tuple[T, float]:
    """Run ``fn`` and return (result, wall seconds), for ``train_seconds``."""
    start = time.perf_counter()
    result = fn()
    return result, time.perf_counter() - start
