"""libsvm scan and write (SRC2, SRC4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Read ``label idx:value ...`` lines into (label double, features vector).

    Without ``num_features`` Spark makes an extra pass to find the largest
    index; give it when known.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", int(num_features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write (label, features) rows as libsvm text, one file per partition."""
    df.select("label", "features").write.mode(mode).format("libsvm").save(path)
    return path
