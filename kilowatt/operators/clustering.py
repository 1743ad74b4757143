"""Cluster centers, nearest-center assignment (EST5, SCO2, INS3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.functions.vectors import nearest_of, squared_distance
from kilowatt.operators.metrics import _as_array, cluster_stats, in_blocks, literal_rows
from kilowatt.operators.partitioning import materialize


def centers(model: KMeansModel) -> DataFrame:
    """Centers as rows (cluster, slot, value)."""
    spark = SparkSession.getActiveSession()
    rows = [(int(i), int(j), float(v)) for i, c in enumerate(model.clusterCenters()) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, slot int, value double")


def label_centers(df: DataFrame, features: str, label: str) -> DataFrame:
    """Mean vector per label: (cluster, center array<double>)."""
    stats = cluster_stats(df, features, label)
    return stats.select("cluster", F.transform("y", lambda v: v / F.col("n")).alias("center"))


def assign_to(
    df: DataFrame, features: str, centers_df: DataFrame, keys: Sequence[str] = (), out: str = "cluster"
) -> DataFrame:
    """Nearest given center (squared Euclidean) for every row.

    The centers are put into the scoring expression as one constant for each
    block of a bounded size, so scoring is a single map over the points: no
    join, no shuffle. Ties go to the smaller cluster id.
    """
    x = _as_array(df, features)
    best = None
    for block in in_blocks(materialize(centers_df.select("cluster", "center")), "center"):
        known = literal_rows(block.collect(), "cluster:long,center:array<double>")
        here = nearest_of(x, known)
        best = here if best is None else F.least(best, here)
    return df.select(*(keys or df.columns), best["c"].cast(centers_df.schema["cluster"].dataType).alias(out))


def lloyd(df: DataFrame, features: str, centers_df: DataFrame, rounds: int = 20, tol: float = 0.0) -> DataFrame:
    """Centers (cluster, center) after Lloyd's rounds from given centers.

    A round assigns every point to its nearest center (a map, see
    :func:`assign_to`) and takes the mean of each cluster (a partial
    aggregation); a cluster without points keeps its center. It ends after
    ``rounds``, or when no center has moved further than ``tol``. Points with a
    null vector are left out.
    """
    points = df.where(F.col(features).isNotNull())
    now = materialize(centers_df.select("cluster", F.col("center").cast("array<double>").alias("center")))
    for _ in range(rounds):
        told = assign_to(points.select(features), features, now, [features], "__cluster")
        means = label_centers(told, features, "__cluster").toDF("cluster", "mean")
        both = materialize(now.join(means, "cluster", "left").select("cluster", "center", F.coalesce("mean", "center").alias("next")))
        moved = both.agg(F.max(F.sqrt(squared_distance(F.col("center"), F.col("next"))))).first()[0]
        now = both.select("cluster", F.col("next").alias("center"))
        if moved is None or moved <= tol:
            break
    return now
