"""Text scan (SRC3): one row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_text(spark: SparkSession, path: str, whole_text: bool = False) -> DataFrame:
    """One row per line in column ``value`` (lines end at \\n, \\r\\n, \\r).

    Files are split into byte ranges, so a large file is read by many
    tasks. ``whole_text`` gives one row per file instead.
    """
    return spark.read.text(path, wholetext=whole_text)
