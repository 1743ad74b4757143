"""Parameter grids, cross-validation and model inspection (TUN1-3, INS1-6).

Cross-validation is the stock validator; ``parallelism`` only sets how many
fits the driver keeps in flight (each is its own set of Spark jobs).
Results come back as DataFrames (one row per setting or parameter)
instead of printed text.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(axes: Mapping[Param, Sequence[Any]]) -> list[dict]:
    """Cartesian product of the given axes (``ParamGridBuilder``)."""
    builder = ParamGridBuilder()
    for param, values in axes.items():
        builder = builder.addGrid(param, list(values))
    return builder.build()


def dedupe_grid(maps: list[dict]) -> list[dict]:
    """Drop settings that equal an earlier one (e.g. leaf budgets that map
    to the same depth), keeping the first."""
    seen, out = set(), []
    for m in maps:
        key = tuple(sorted((p.parent, p.name, repr(v)) for p, v in m.items()))
        if key not in seen:
            seen.add(key)
            out.append(m)
    return out


def regression_evaluator(label: str = "load", metric: str = "rmse", prediction: str = "prediction") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)


def cross_validate(
    estimator: Estimator,
    param_maps: list[dict],
    evaluator: Evaluator,
    df: DataFrame,
    num_folds: int,
    fold_col: str,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """k-fold CV: mean metric per setting, pick the best, refit on all rows.

    The stock validator over given folds: ``fold_col`` holds ``0..k-1``, as
    :func:`kilowatt.operators.splits.with_folds` gives from the row's key,
    so a retried task never moves a row to another fold. The validator keeps
    one fold's training and validation rows cached at a time and fits up to
    ``parallelism`` settings at once; the caller need not cache ``df``, but
    should give a stored or checkpointed input, since every fold reads it.
    """
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=param_maps, evaluator=evaluator,
        numFolds=int(num_folds), foldCol=fold_col, parallelism=int(parallelism), collectSubModels=False,
    ).fit(df)


@dataclass
class LinearFits:
    """Least-squares fits of one search: (setting, fold or None for all rows) ->
    (coefficients, intercept), and (setting, fold) -> metrics on that fold."""

    fits: dict[tuple[tuple[bool, float], int | None], tuple[np.ndarray, float]]
    scores: dict[tuple[tuple[bool, float], int], dict[str, float]]

    def average(self, setting: tuple[bool, float], metric: str) -> float:
        values = [v[metric] for (s, _), v in self.scores.items() if s == setting]
        return sum(values) / len(values)

    def best(self, metric: str = "rmse") -> tuple[bool, float]:
        settings = list(dict.fromkeys(s for s, _ in self.scores))
        return (max if metric == "r2" else min)(settings, key=lambda s: self.average(s, metric))


def linear_cv(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[tuple[bool, float]], folds: int, fold_col: str, mae: bool = True) -> LinearFits:
    """Cross-validated least squares from one scan: sums by subtraction (TUN2).

    A setting is (fit_intercept, ridge penalty on the sum of squared errors over
    n). One aggregation gives each fold's sums of products of (1, features,
    label); a training set's sums are the total less its fold's, and its normal
    equations are solved from them. Squared errors of a fold follow from its own
    sums; the mean absolute error needs a second scan (``mae``). Rows with a
    null label, feature or fold are left out; no rows: no fits. The driver holds
    folds x (features + 2) squared numbers.
    """
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    rows = df.dropna(subset=[*features, label, fold_col])
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    # sums are taken around a first mean, so that no digits are lost to large values
    middle = rows.agg(*[F.avg(c).alias(str(k)) for k, c in enumerate(names)]).first()
    at = [0.0] + [float(middle[str(k)] or 0.0) for k in range(1, d)]
    shifted = [c - F.lit(m) for c, m in zip(names, at, strict=True)]
    sums = rows.groupBy(F.col(fold_col).alias("fold")).agg(*[F.sum(shifted[i] * shifted[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    per = {}
    for row in sums:
        m = np.zeros((d, d))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
        back = np.eye(d)
        back[1:, 0] = at[1:]
        per[int(row["fold"])] = back @ m @ back.T, m
    shift = np.array(at)

    def solve(m: np.ndarray, raw: np.ndarray, intercept: bool, reg: float) -> tuple[np.ndarray, float]:
        n = m[0, 0]
        if intercept:  # around the training means
            mean = m[0, 1:] / n
            own = m[1:, 1:] - n * np.outer(mean, mean)
            b = np.linalg.lstsq(own[:-1, :-1] + reg * n * np.eye(d - 2), own[:-1, -1], rcond=None)[0]
            return b, float(mean[-1] + shift[-1] - b @ (mean[:-1] + shift[1:-1]))
        return np.linalg.lstsq(raw[1:-1, 1:-1] + reg * n * np.eye(d - 2), raw[1:-1, -1], rcond=None)[0], 0.0

    raw, around = (sum((v[k] for v in per.values()), np.zeros((d, d))) for k in (0, 1))
    fits, scores = {}, {}
    for setting in settings if per else []:
        for fold in [None, *range(folds)]:
            own = per.get(fold, (np.zeros((d, d)),) * 2)
            fits[setting, fold] = solve(around - own[1], raw - own[0], *setting)
    for setting in settings if per else []:
        for fold in [k for k in range(folds) if k in per]:
            b, a = fits[setting, fold]
            m = per[fold][1]
            # the error of a row is (label - middle) - b (x - middle) - c
            weight = np.concatenate([[-(a + b @ shift[1:-1] - shift[-1])], -b, [1.0]])
            n, se = m[0, 0], float(weight @ m @ weight)
            spread = m[-1, -1] - m[0, -1] ** 2 / n
            found = {"rmse": (max(se, 0.0) / n) ** 0.5, "mse": se / n, "r2": 1 - se / spread if spread else float("nan")}
            scores[setting, fold] = {k: float(v) for k, v in found.items()}
    if mae and scores:
        errors = []
        for k, setting in enumerate(settings):
            guess = F.lit(None).cast("double")
            for fold in range(folds):
                b, a = fits[setting, fold]
                value = sum((F.lit(float(w)) * c for w, c in zip(b, names[1:-1], strict=True)), F.lit(a))
                guess = F.when(F.col(fold_col) == fold, value).otherwise(guess)
            errors.append(F.avg(F.abs(names[-1] - guess)).alias(str(k)))
        for row in rows.groupBy(F.col(fold_col).alias("fold")).agg(*errors).collect():
            for k, setting in enumerate(settings):
                if (setting, row["fold"]) in scores:
                    scores[setting, row["fold"]]["mae"] = row[str(k)]
    return LinearFits(fits, scores)


def _plain(v: Any) -> Any:
    if isinstance(v, (bool, int, float, str)) or v is None:
        return v
    return str(v)


def cv_results(cv_model: CrossValidatorModel) -> DataFrame:
    """One row per setting: (setting, params JSON, avg_metric, std_metric)."""
    spark = SparkSession.getActiveSession()
    stds = cv_model.stdMetrics or [None] * len(cv_model.avgMetrics)
    rows = []
    for i, (m, avg, std) in enumerate(zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics, stds)):
        params = {p.name: _plain(v) for p, v in sorted(m.items(), key=lambda kv: kv[0].name)}
        rows.append((i, json.dumps(params, sort_keys=True), float(avg), None if std is None else float(std)))
    return spark.createDataFrame(rows, "setting int, params string, avg_metric double, std_metric double")


def best(cv_model: CrossValidatorModel):
    """The refitted best model; for a pipeline, its last stage."""
    model = cv_model.bestModel
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def best_params(cv_model: CrossValidatorModel) -> DataFrame:
    """The chosen estimator's full parameter map as rows (param, value)."""
    spark = SparkSession.getActiveSession()
    stage = best(cv_model)
    rows = sorted((p.name, json.dumps(_plain(v))) for p, v in stage.extractParamMap().items())
    return spark.createDataFrame(rows, "param string, value string")


def describe(model) -> DataFrame:
    """A tree model's readable dump as rows (line_no, line)."""
    spark = SparkSession.getActiveSession()
    lines = model.toDebugString.splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
