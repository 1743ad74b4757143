"""Evaluators as aggregations (EVA1-EVA6).

Each metric is one distributed aggregation: per-partition partial sums,
a tiny final merge. No prediction column is collected.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kilowatt.functions.metrics import metrics_from_sums, regression_sums
from kilowatt.functions.vectors import to_array
from kilowatt.operators.partitioning import materialize

#: Numbers of cluster statistics that are put into a plan at a time; more are taken in blocks.
MAX_INLINE_VALUES = 1 << 20


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mse, r2, mae (and n) in one pass; per group when ``keys`` given.

    Same definitions as ``RegressionEvaluator``: r2 = 1 - SSE / SST.
    """
    sums = df.groupBy(*keys).agg(*regression_sums(label, prediction))
    return sums.select(*keys, "n", *metrics_from_sums())


#: Distinct scores in one range of the AUC's running sum.
SCORES_PER_RANGE = 1_000_000


def auc(df: DataFrame, label: str, score: str, scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Exact area under ROC (ties count one half), as one row ``auc``.

    Equals ``BinaryClassificationEvaluator(numBins=0)``. Rows are reduced to
    one per distinct score (partial aggregation), which is computed once into
    a checkpoint; then the prefix sum of negatives below each score is taken
    in ranges of about ``scores_per_range`` distinct scores: range totals give
    each range's offset, and a window within each range adds the rest. Range
    bounds are approximate quantiles of the distinct scores, and the range of
    a score is a pure expression: recomputing any part after a lost executor
    gives the same ranges.
    """
    y = F.col(label).cast("double")
    per_score = materialize(df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).alias("__s")).agg(
        F.sum(F.when(y == 1.0, 1).otherwise(0)).cast("double").alias("__pos"),
        F.sum(F.when(y == 1.0, 0).otherwise(1)).cast("double").alias("__neg"),
    ))
    ranges = max(1, -(-per_score.count() // int(scores_per_range)))
    bounds: list[float] = []
    if ranges > 1:
        probs = [i / ranges for i in range(1, ranges)]
        bounds = per_score.select(F.percentile_approx(F.col("__s").cast("double"), probs, 10 * ranges)).first()[0]
    bounds = sorted(set(float(b) for b in bounds))
    lits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    bucketed = per_score.withColumn(
        "__p", F.size(F.filter(lits, lambda b: b < F.col("__s").cast("double")))
    )
    totals = bucketed.groupBy("__p").agg(F.sum("__neg").alias("__pn"))
    offsets = totals.select(
        "__p",
        F.coalesce(
            F.sum("__pn").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        ).alias("__off"),
    )
    w = Window.partitionBy("__p").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    within = bucketed.withColumn("__below", F.coalesce(F.sum("__neg").over(w), F.lit(0.0)))
    joined = within.join(F.broadcast(offsets), "__p")  # one row per range
    # one class only (or no rows): AUC is undefined -> null
    return joined.agg(
        F.try_divide(
            F.sum(F.col("__pos") * (F.col("__off") + F.col("__below") + 0.5 * F.col("__neg"))),
            F.sum("__pos") * F.sum("__neg"),
        ).alias("auc")
    )


def _as_array(df: DataFrame, features: str):
    kind = df.schema[features].dataType
    if isinstance(kind, VectorUDT):
        return to_array(features)
    return F.col(features).cast("array<double>")


def cluster_stats(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Per cluster: n, sum of squared norms (psi), vector sum (y), in one pass
    with partial aggregation (``Summarizer``); no vector is exploded."""
    arr = _as_array(df, features)
    points = df.select(F.col(cluster).alias("cluster"), array_to_vector(arr).alias("x"))
    made = points.groupBy("cluster").agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col("x")).alias("s"))
    norms = F.transform(vector_to_array("s.normL2"), lambda v: v * v)
    return made.select(
        "cluster", F.col("s.count").cast("double").alias("n"),
        F.aggregate(norms, F.lit(0.0), lambda acc, v: acc + v).alias("psi"), vector_to_array("s.sum").alias("y"))


def in_blocks(rows: DataFrame, vector: str) -> list[DataFrame]:
    """``rows`` as one or more parts of about MAX_INLINE_VALUES numbers, to be
    collected one at a time; the size is found by an aggregate first."""
    size = rows.agg(F.sum(F.size(vector).cast("long"))).first()[0] or 0
    blocks = -(-int(size) // MAX_INLINE_VALUES)
    if blocks <= 1:
        return [rows]
    part = F.pmod(F.xxhash64("cluster"), F.lit(blocks))
    return [rows.where(part == k) for k in range(blocks)]


def literal_rows(rows: list[Row], fields: str) -> Column:
    """Rows as one constant array of structs: a single JSON literal, parsed once
    when the plan is folded, not an expression for each number."""
    text = json.dumps([{k: v for k, v in r.asDict().items()} for r in rows])
    return F.from_json(F.lit(text), f"array<struct<{fields}>>")


def silhouette(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean silhouette, squared Euclidean distance, for given cluster labels.

    Distance of x to cluster C: |x|^2 + psi_C/n_C - 2 x.y_C/n_C; own cluster
    scaled by n/(n-1); one-point clusters score 0. Cluster statistics are
    k rows; they are put into the scoring expression block by block, each of a
    bounded size, so the points are scored in one pass with no join.
    """
    kind = df.schema[cluster].dataType.simpleString()
    stats = cluster_stats(df, features, cluster).select("cluster", "n", "psi", "y")
    blocks = in_blocks(materialize(stats), "y")
    x = _as_array(df, features)
    pts = df.select(F.col(cluster).alias("__c"), x.alias("__x"))
    pts = pts.withColumn("__xx", F.aggregate("__x", F.lit(0.0), lambda a, v: a + v * v))

    def dist(s):
        xy = F.aggregate(F.zip_with(F.col("__x"), s["y"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.col("__xx") + s["psi"] / s["n"] - 2.0 * xy / s["n"]

    nothing = F.struct(F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("d"))
    pts = pts.withColumn("__own", nothing).withColumn("__b", F.lit(None).cast("double"))
    for block in blocks:
        clusters = literal_rows(block.collect(), f"cluster:{kind},n:double,psi:double,y:array<double>")
        d = F.transform(clusters, lambda s: F.struct(s["cluster"].alias("c"), s["n"].alias("n"), dist(s).alias("d")))
        pts = pts.withColumn("__d", d)
        own = F.transform(F.filter("__d", lambda e: e["c"] == F.col("__c")), lambda e: F.struct(e["n"].alias("n"), e["d"].alias("d")))
        nearest_other = F.array_min(F.transform(F.filter("__d", lambda e: e["c"] != F.col("__c")), lambda e: e["d"]))
        pts = pts.withColumn("__own", F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(F.col("__own"))).withColumn(
            "__b", F.least("__b", nearest_other))
    own, b = F.col("__own"), F.col("__b")
    a = F.try_divide(own["d"] * own["n"], own["n"] - 1.0)
    s = (
        F.when(own["n"] <= 1.0, F.lit(0.0))
        .when(a < b, 1.0 - F.try_divide(a, b))
        .when(a > b, F.try_divide(b, a) - 1.0)
        .otherwise(F.lit(0.0))
    )
    return pts.agg(F.avg(s).alias("silhouette"))


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """accuracy and weighted precision / recall / f1 (weights = label counts),
    as ``MulticlassClassificationEvaluator`` defines them.

    One pass: every row emits a "label" record for its true class (with a
    hit flag) and a "prediction" record for its predicted class; a single
    partial-aggregated groupBy on the class gives n_label, n_pred and true
    positives, then one tiny global aggregate gives the four metrics.
    Rows with a null label or prediction are left out.
    """
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    records = df.where(y.isNotNull() & p.isNotNull()).select(F.explode(F.array(
        F.struct(y.alias("k"), F.lit(1).alias("is_label"), F.lit(0).alias("is_pred"), (y == p).cast("int").alias("hit")),
        F.struct(p.alias("k"), F.lit(0).alias("is_label"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")),
    )).alias("e"))
    per = records.groupBy(F.col("e.k").alias("k")).agg(
        F.sum("e.is_label").cast("double").alias("n_label"),
        F.sum("e.is_pred").cast("double").alias("n_pred"),
        F.sum("e.hit").cast("double").alias("tp"),
    )
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_label") > 0, F.col("tp") / F.col("n_label")).otherwise(0.0)
    per = per.select("n_label", "tp", prec.alias("prec"), rec.alias("rec"))
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    n = F.sum("n_label")
    return per.agg(
        F.try_divide(F.sum("tp"), n).alias("accuracy"),
        F.try_divide(F.sum(F.col("prec") * F.col("n_label")), n).alias("weighted_precision"),
        F.try_divide(F.sum(F.col("rec") * F.col("n_label")), n).alias("weighted_recall"),
        F.try_divide(F.sum(f1 * F.col("n_label")), n).alias("weighted_f1"),
    )
