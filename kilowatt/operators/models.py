"""Estimators and scoring (EST1-EST9, SCO1, PIP1-2).

All training is ``pyspark.ml``: trees aggregate per-node split statistics
across executors level by level; only the model returns to the driver.
Every stochastic estimator takes an explicit ``seed``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor


def _deep_tree_params(max_depth: int, params: dict) -> dict:
    """Deep trees (depth > 10) keep each row's node id cached between
    levels instead of re-walking the tree, and checkpoint that cache every
    10 iterations (into the session's shared checkpoint folder) so its
    lineage stays short."""
    if max_depth > 10:
        params.setdefault("cacheNodeIds", True)
        params.setdefault("checkpointInterval", 10)
    return params


def forest(
    label: str = "load",
    features: str = "features",
    num_trees: int = 20,
    max_depth: int = 5,
    max_bins: int = 32,
    seed: int = 42,
    **params,
) -> RandomForestRegressor:
    """Random-forest regression (reference grid: numTrees 60, 80)."""
    return RandomForestRegressor(
        labelCol=label, featuresCol=features, numTrees=num_trees, maxDepth=max_depth,
        maxBins=max_bins, seed=seed, **_deep_tree_params(max_depth, params),
    )


def gbt(
    label: str = "load",
    features: str = "features",
    max_iter: int = 20,
    max_depth: int = 5,
    step_size: float = 0.1,
    max_bins: int = 32,
    seed: int = 42,
    **params,
) -> GBTRegressor:
    """Gradient-boosted regression trees (squared loss)."""
    return GBTRegressor(
        labelCol=label, featuresCol=features, maxIter=max_iter, maxDepth=max_depth,
        stepSize=step_size, maxBins=max_bins, seed=seed, **_deep_tree_params(max_depth, params),
    )


def leaf_budget_depth(max_depth: int, num_leaves: int) -> int:
    """Depth that keeps a level-wise tree within ``num_leaves`` leaves.

    MLlib grows trees level by level and has no leaf cap, so a leaf budget
    L becomes ``min(max_depth, floor(log2 L))`` (at most L leaves). Same
    model family as leaf-wise boosting, not the same trees.
    """
    if num_leaves < 2:
        raise ValueError("num_leaves must be at least 2")
    return max(1, min(int(max_depth), int(math.floor(math.log2(num_leaves)))))


def leaf_budget_gbt(
    max_depth: int = 5,
    num_leaves: int = 31,
    learning_rate: float = 0.1,
    max_iter: int = 100,
    label: str = "load",
    features: str = "features",
    seed: int = 42,
    **params,
) -> GBTRegressor:
    """Boosted trees with a leaf budget and learning rate (EST4)."""
    return gbt(
        label=label, features=features, max_iter=max_iter,
        max_depth=leaf_budget_depth(max_depth, num_leaves), step_size=learning_rate,
        seed=seed, **params,
    )


def stump(kind: str, label: str, features: str, max_bins: int = 64, seed: int = 42) -> Estimator:
    """Depth-1 tree over all rows: a forest of one tree without bootstrap,
    a one-round GBT, or a leaf budget of 2. All three give the best single
    split, predicting the mean of each side."""
    if kind == "forest":
        return RandomForestRegressor(
            labelCol=label, featuresCol=features, numTrees=1, maxDepth=1, maxBins=max_bins,
            bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="all", seed=seed,
        )
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol=features, maxIter=1, maxDepth=1, maxBins=max_bins, seed=seed)
    if kind == "leaf_budget":
        return leaf_budget_gbt(max_depth=8, num_leaves=2, max_iter=1, label=label, features=features,
                               seed=seed, max_bins=max_bins)
    raise ValueError(kind)


def kmeans(k: int = 2, seed: int = 1, features: str = "features", max_iter: int = 20, **params) -> KMeans:
    """k-means with parallel k-means++ init (``k-means||``)."""
    return KMeans(k=k, seed=seed, featuresCol=features, maxIter=max_iter, **params)


def logistic(label: str = "label", features: str = "features", max_iter: int = 100, reg: float = 0.0, **params) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=features, maxIter=max_iter, regParam=reg, **params)


def linear(label: str, features: str = "features", reg: float = 0.0, elastic_net: float = 0.0, **params) -> LinearRegression:
    """Least squares; ``reg > 0`` with ``elastic_net = 0`` is ridge."""
    return LinearRegression(labelCol=label, featuresCol=features, regParam=reg, elasticNetParam=elastic_net, **params)


def forest_classifier(label: str = "label", features: str = "features", num_trees: int = 20, seed: int = 42, **params) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=num_trees, seed=seed, **params)


def pipeline(stages: Sequence[Estimator | Transformer]) -> Pipeline:
    """Chain stages; an already fitted model is a plain transformer and is
    not refitted."""
    return Pipeline(stages=list(stages))
