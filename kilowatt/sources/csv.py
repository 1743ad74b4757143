"""CSV scan and write (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    header: bool = True,
    multiline: bool = False,
    infer: bool | None = None,
    **options: str,
) -> DataFrame:
    """Read delimited text with a header row.

    The reference reads with ``header``, ``multiLine`` and ``inferSchema``
    all on. Both have a cost at scale: inference is an extra full pass
    over the input, and ``multiLine`` turns every file into one task.
    So: give ``schema`` whenever it is known (inference is then off), and
    keep ``multiline`` for inputs with quoted line breaks, written as many
    files so the scan still runs in parallel.
    """
    reader = spark.read.format("csv").option("header", header).option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True if infer is None else infer)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> str:
    """Write with a header row, one file per partition (parallel write)."""
    df.write.mode(mode).option("header", header).csv(path)
    return path
