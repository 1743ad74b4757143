"""Partition-discovered file scan (SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_files(
    spark: SparkSession, path: str, glob: str | None = None, with_content: bool = True
) -> DataFrame:
    """Whole files as rows: path, modificationTime, length, content, plus one
    column per ``key=value`` directory level (partition discovery).

    Filters on the partition columns prune directories before any file is
    opened. Drop ``content`` when only metadata is needed; Spark then skips
    reading the bytes.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df if with_content else df.drop("content")
