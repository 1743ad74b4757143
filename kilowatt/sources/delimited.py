"""Delimited scans of the sample formats (SRC5).

Each format is read with an explicit schema, so there is no inference
pass and no per-row Python: multi-character separators go through the
CSV reader, space-separated number rows through ``split``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_delimited(
    spark: SparkSession, path: str, sep: str, schema: StructType | str, header: bool = False
) -> DataFrame:
    """Separated values with a fixed schema; ``sep`` may be several chars."""
    return (
        spark.read.format("csv")
        .option("sep", sep)
        .option("header", header)
        .schema(schema)
        .load(path)
    )


def scan_number_rows(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Rows of numbers (``1.0 2.0 3.0``) -> (values array<double>)."""
    raw = spark.read.text(path)
    parts = F.split(F.trim(F.col("value")), sep + "+")
    return raw.where(F.trim(F.col("value")) != "").select(
        F.transform(parts, lambda x: x.cast("double")).alias("values")
    )


def scan_labeled_rows(spark: SparkSession, path: str) -> DataFrame:
    """``label,f1 f2 ...`` rows -> (label double, values array<double>)."""
    raw = spark.read.text(path).where(F.trim(F.col("value")) != "")
    label = F.split(F.col("value"), ",").getItem(0).cast("double")
    rest = F.split(F.trim(F.substring_index(F.col("value"), ",", -1)), " +")
    return raw.select(label.alias("label"), F.transform(rest, lambda x: x.cast("double")).alias("values"))


def scan_baskets(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """One basket per line, items separated by ``sep`` -> (items array<string>)."""
    raw = spark.read.text(path).where(F.trim(F.col("value")) != "")
    return raw.select(F.array_distinct(F.split(F.trim(F.col("value")), sep + "+")).alias("items"))
