"""Fitted trees as a table, and scoring from it (INS6, SCO1).

A node is a row: (tree, node, slot, threshold, categories, left, right, value,
gain, n); slot is null in a leaf. A row of data goes left where its slot is at
most the threshold, or is one of the categories.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.session import scratch_path

SCHEMA = ("tree int, node int, slot int, threshold double, categories array<double>, left int, right int, "
          "value double, gain double, n long")


def node_table(spark: SparkSession, nodes: Sequence[tuple]) -> DataFrame:
    """Nodes as :meth:`kilowatt.operators.boosting.Fits.of` gives them."""
    return spark.createDataFrame(list(nodes), SCHEMA)


def model_nodes(model) -> DataFrame:
    """The node table of a fitted pyspark.ml tree, forest or boosted model: the
    model is saved to the shared scratch folder, and its node files are read. A
    tree's values are not weighted; see :func:`model_weights`."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID").cast("int") if "treeID" in data.columns else F.lit(0)
    node = F.col("nodeData") if "nodeData" in data.columns else F.struct(*data.columns)
    rows = data.select(tree.alias("tree"), node.alias("d"))
    inner, given = F.col("d.leftChild") >= 0, F.col("d.split.leftCategoriesOrThreshold")
    # a split of a categorical slot says how many categories there are; -1: a threshold
    by_category = inner & (F.col("d.split.numCategories") >= 0)
    only = lambda condition, value: F.when(condition, value)
    return rows.select(
        "tree", F.col("d.id").cast("int").alias("node"), only(inner, F.col("d.split.featureIndex")).cast("int").alias("slot"),
        only(inner & ~by_category, given[0]).alias("threshold"), only(by_category, given).alias("categories"),
        only(inner, F.col("d.leftChild")).cast("int").alias("left"), only(inner, F.col("d.rightChild")).cast("int").alias("right"),
        F.col("d.prediction").alias("value"), only(inner, F.col("d.gain")).alias("gain"), F.col("d.rawCount").alias("n"))


def model_weights(model) -> list[float]:
    """What each tree's value is multiplied with: a forest takes the mean, boosting its weights."""
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    return weights if "GBT" in type(model).__name__ else [w / len(weights) for w in weights]


def _constant(values: list, kind: str) -> Column:
    """A list as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str] | str, start: float = 0.0, weights: Sequence[float] | None = None,
          out: str = "prediction") -> DataFrame:
    """df with ``out``: start plus the sum of the trees' values times their weights (1).

    ``features``: columns, or one array column. Scoring is a map of built-in
    expressions: the nodes, whose number is the model's and does not grow with
    the data, are constants of the plan, and every row walks the trees there. A
    null feature goes right.
    """
    rows = nodes.orderBy("tree", "node").collect()  # the model
    at = {(r["tree"], r["node"]): k for k, r in enumerate(rows)}
    trees = sorted({r["tree"] for r in rows})
    first = {t: min(r["node"] for r in rows if r["tree"] == t) for t in trees}
    depth, level = 0, [at[t, first[t]] for t in trees]
    step = {k: [at[r["tree"], r[c]] for c in ("left", "right")] for k, r in enumerate(rows) if r["slot"] is not None}
    while level := [c for k in level if k in step for c in step[k]]:
        depth += 1
    weights = weights or [1.0] * len(trees)
    number = [0 if r["slot"] is None else r["slot"] + 1 for r in rows]
    nodes_by = {
        "slot": _constant(number, "int"), "threshold": _constant([r["threshold"] for r in rows], "double"),
        "categories": _constant([r["categories"] for r in rows], "array<double>"),
        "left": _constant([step.get(k, [k])[0] for k in range(len(rows))], "int"), "right": _constant([step.get(k, [k])[-1] for k in range(len(rows))], "int"),
        "value": _constant([r["value"] * weights[trees.index(r["tree"])] for r in rows], "double"),
    }
    values = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])

    def walked(root: Column) -> Column:
        def down(k: Column, _: Column) -> Column:
            x = F.get(values, F.get(nodes_by["slot"], k) - 1)
            threshold, known = F.get(nodes_by["threshold"], k), F.get(nodes_by["categories"], k)
            to_left = F.coalesce(F.when(known.isNotNull(), F.array_contains(known, x)).otherwise(x <= threshold), F.lit(False))
            return F.when(F.get(nodes_by["slot"], k) == 0, k).when(to_left, F.get(nodes_by["left"], k)).otherwise(F.get(nodes_by["right"], k))

        return F.reduce(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, down)

    if not trees:
        return df.withColumn(out, F.lit(float(start)))
    roots = _constant([at[t, first[t]] for t in trees], "int")
    return df.withColumn(out, F.reduce(roots, F.lit(float(start)), lambda total, root: total + F.get(nodes_by["value"], walked(root))))
