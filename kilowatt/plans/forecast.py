"""End-to-end load forecasting on the driver's ``events`` table.

events -> hourly load per (keys, hour) -> value 24 h / 48 h earlier ->
calendar fields -> time split -> assemble -> model (persistence, forest,
boosted trees, leaf-budget boosting) with k-fold CV -> score -> metrics.

This is the reference's forecasting program re-aimed at the driver
tables (its own CSV is not shipped): ``load`` is the hourly sum of
``events.value``; the contemporaneous weather columns are replaced by
the hour's event count.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.operators import features as fea
from kilowatt.operators import boosting, models, trees, tuning
from kilowatt.operators.metrics import regression_metrics
from kilowatt.operators.partitioning import by_key, materialize, train_partitions
from kilowatt.operators.prep import asof_join, calendar, hourly, lag_by_time
from kilowatt.operators.relational import before, not_before
from kilowatt.operators.splits import random_split, time_split, with_folds

# The split of the reference (train before the first day of
# the test month, test one month, later rows dropped), moved to the
# driver's 30-day events table.
T_TEST = "2024-01-22 00:00:00"
T_END = "2024-01-31 00:00:00"
LABEL = "load"
FEATURES = ("n_events", "dow", "doy", "month", "hour", "minute", "t_m24", "t_m48")
METRIC_COLS = ("n", "rmse", "mse", "r2", "mae")

# The reference's parameter grids and CV settings.
FOREST_NUM_TREES = (60, 80)
GBT_MAX_DEPTH = (5, 10)
GBT_ROUNDS = 20
INDEXED_GBT_MAX_DEPTH = (8, 9)
INDEXED_GBT_ROUNDS = 300
CATEGORY_LIMIT = 4
LEAF_MAX_DEPTH = (3, 4, 5, 6, 7, 8)
LEAF_NUM_LEAVES = (16, 20, 31, 40, 60)
LEAF_LEARNING_RATE = (0.05, 0.1)
LEAF_ROUNDS = 100
LEAF_MIN_ROWS = 20
CV_FOLDS = 3
LEAF_CV_FOLDS = 5
LAGS = (24, 48)
RANDOM_SPLIT = (0.7, 0.3)

#: Partitions of the training set of one hourly series.
SERIES_PARTITIONS = 1


def load_series(
    spark: SparkSession, sf_dir: str, keys: Sequence[str] = (), unit: str = "hour",
    observed: str | None = None, start: str | None = None,
) -> DataFrame:
    """Load per (keys, period) with 24 h / 48 h lags and calendar fields.

    ``unit`` is the period ("hour", or "day" for a sparse per-user panel:
    the lags are then the two previous days). With ``observed`` (an event
    type), ``obs_value`` is the value of the latest such event of the same
    keys at or before the period start, joined as of that time: an outside
    reading taken at its own times, like the reference's weather columns.

    Events from ``T_END`` on never matter, and with ``start`` only periods from
    then on are wanted: both bounds are conditions on the raw time column, so
    they reach the scan. Rows before ``start`` that only serve as lags are
    part of the result; the caller's split drops them.
    """
    events = before(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", T_END)
    readings = events
    if start:
        first = dt.datetime.fromisoformat(start) - dt.timedelta(hours=max(LAGS))
        events = not_before(events, "ts", first)
    series = hourly(events.select("ts", "value", *keys), "ts", "value", keys=keys, unit=unit)
    series = lag_by_time(series, "hour_ts", LABEL, hours=LAGS, keys=keys)
    series = calendar(series, "hour_ts")
    if observed:
        # the as-of join reads its left side several times: compute it once
        series = materialize(series)
        readings = readings.where(F.col("event_type") == observed).select(
            *keys, F.col("ts").alias("obs_ts"), F.col("value").alias("obs_value"), F.col("event_id").alias("obs_id")
        )
        series = asof_join(series, readings, "hour_ts", "obs_ts", keys=keys, right_cols=["obs_value"],
                           tiebreak="obs_id", bucket_seconds=86_400 * (7 if unit == "day" else 1))
    return series


def split_series(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    return time_split(series, "hour_ts", T_TEST, T_END)


def persistence_metrics(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ()) -> DataFrame:
    """Score ``prediction = t_m24`` on the test window (no training)."""
    _, test = split_series(load_series(spark, sf_dir, keys, start=T_TEST))
    scored = test.where(F.col("t_m24").isNotNull()).withColumn("prediction", F.col("t_m24"))
    return regression_metrics(scored, LABEL)


@dataclass
class ForecastRun:
    cv_model: CrossValidatorModel
    test_scored: DataFrame
    metrics: DataFrame


def _estimator(kind: str, seed: int):
    """(stages before the estimator, estimator, grid axes, folds): the reference's."""
    if kind == "forest":
        est = models.forest(label=LABEL, features="features", seed=seed)
        return [], est, {est.numTrees: list(FOREST_NUM_TREES)}, CV_FOLDS
    if kind == "gbt":
        est = models.gbt(label=LABEL, features="features", max_iter=GBT_ROUNDS, seed=seed)
        return [], est, {est.maxDepth: list(GBT_MAX_DEPTH)}, CV_FOLDS
    raise ValueError(kind)


def training_rows(
    spark: SparkSession, sf_dir: str, keys: Sequence[str] = (), unit: str = "hour", observed: str | None = None,
    split: str = "time", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of assembled rows (keys, hour_ts, load, features).

    The series is computed once into a checkpoint: training folds and scoring
    read that, not the events. Rows whose lags are missing (start of a
    series) are skipped. ``split``: "time" (the test month after the training
    window) or "random" (70/30 of the window by the hash of the row's keys).
    """
    series = load_series(spark, sf_dir, keys, unit=unit, observed=observed)
    cols = FEATURES + (("obs_value",) if observed else ())
    rows = fea.assemble(series, cols, "features", invalid="skip").select(*keys, "hour_ts", LABEL, "features")
    rows = materialize(rows)
    if split == "random":
        train, test = random_split(rows, list(RANDOM_SPLIT), seed, [*keys, "hour_ts"])
        return train, test
    return split_series(rows)


def forecast(
    spark: SparkSession,
    sf_dir: str,
    kind: str = "forest",
    keys: Sequence[str] = (),
    axes_override: dict | None = None,
    num_folds: int | None = None,
    parallelism: int = 8,
    seed: int = 42,
    select_by: str = "rmse",
    unit: str = "hour",
    observed: str | None = None,
    split: str = "time",
    partitions: int | None = None,
) -> ForecastRun:
    """Fit with k-fold CV on the training rows and score the test rows.

    Folds come from the hash of the row's keys, and the training set has a
    fixed layout (:func:`by_key`): the model depends on the rows, the seed and
    ``partitions`` alone. A series without keys has one row an hour, however
    many events there are: ``SERIES_PARTITIONS``; a panel has
    as many as its number of rows asks for, unless the caller gives a number.
    ``parallelism`` is how many settings are fitted at once.
    """
    train, test = training_rows(spark, sf_dir, keys, unit, observed, split, seed)
    partitions = partitions or (train_partitions(train) if keys else SERIES_PARTITIONS)
    pre, est, axes, folds = _estimator(kind, seed)
    folds = num_folds or folds
    if axes_override:
        axes = {getattr(est, name): values for name, values in axes_override.items()}
    depths = [v for p, values in axes.items() if p.name == "maxDepth" for v in values]
    if depths and max(depths) > 10 and est.hasParam("cacheNodeIds"):
        est.setCacheNodeIds(True).setCheckpointInterval(10)  # deep settings in the grid
    maps = tuning.dedupe_grid(tuning.grid(axes))
    ids = [*keys, "hour_ts"]
    train = by_key(with_folds(train, folds, ids, seed=seed), ids, partitions)
    cv_model = tuning.cross_validate(models.pipeline([*pre, est]), maps, tuning.regression_evaluator(LABEL, select_by),
                                     train, num_folds=folds, fold_col="fold", parallelism=min(parallelism, len(maps)))
    scored = cv_model.transform(test)
    return ForecastRun(cv_model, scored, regression_metrics(scored, LABEL))


def boosted_settings(kind: str) -> list[boosting.Setting]:
    """The reference's grids of boosted trees over indexed features."""
    if kind == "indexed_gbt":
        return [boosting.Setting(depth, None, 0.1, INDEXED_GBT_ROUNDS, 1, "tree") for depth in INDEXED_GBT_MAX_DEPTH]
    if kind == "leaf_budget":
        return [boosting.Setting(depth, leaves, rate, LEAF_ROUNDS, LEAF_MIN_ROWS)
                for depth in LEAF_MAX_DEPTH for leaves in LEAF_NUM_LEAVES for rate in LEAF_LEARNING_RATE]
    raise ValueError(kind)


@dataclass
class BoostedRun:
    setting: boosting.Setting
    averages: dict[boosting.Setting, float]
    nodes: DataFrame
    test_scored: DataFrame
    metrics: DataFrame


def boosted_forecast(
    spark: SparkSession, sf_dir: str, kind: str, settings: Sequence[boosting.Setting] | None = None, folds: int | None = None,
    split: str = "random", seed: int = 42, select_by: str = "rmse",
) -> BoostedRun:
    """All settings and folds of a grid of boosted trees fitted in one pass, the
    best setting by its mean over the folds, and the test rows scored with that
    setting's fit on all training rows.

    Which features are categories (at most ``CATEGORY_LIMIT`` values) is found once,
    on all rows, before the split; bins come from the training rows.
    """
    train, test = training_rows(spark, sf_dir, split=split, seed=seed)
    names = [f"x{k}" for k in range(len(FEATURES))]
    plain = lambda df: df.select("hour_ts", LABEL, *[vector_to_array("features")[k].alias(c) for k, c in enumerate(names)])
    train, test = plain(train), plain(test)
    settings = list(settings or boosted_settings(kind))
    folds = folds or (LEAF_CV_FOLDS if kind == "leaf_budget" else CV_FOLDS)
    bins = boosting.MOST_BINS if kind == "leaf_budget" else 32
    every = boosting.find_slots(train.unionByName(test), names, bins, CATEGORY_LIMIT)
    slots = [a if a.categories else b for a, b in zip(every, boosting.find_slots(train, names, bins), strict=True)]
    rows = by_key(with_folds(train, folds, ["hour_ts"], seed=seed), ["hour_ts"], SERIES_PARTITIONS)
    fits = boosting.fit_many(rows, names, LABEL, settings, folds, "fold", slots=slots)
    values: dict[boosting.Setting, list[float]] = {s: [] for s in settings}
    for setting, _, found in fits.metrics():
        values[setting].append(found[select_by])
    averages = {s: sum(v) / len(v) for s, v in values.items() if v}
    best = (max if select_by == "r2" else min)(averages, key=averages.get)
    start, rows = fits.of(best)
    nodes = trees.node_table(spark, rows)
    scored = trees.score(test, nodes, names, start)
    return BoostedRun(best, averages, nodes, scored, regression_metrics(scored, LABEL))


def boosted_report(run: BoostedRun, kind: str) -> DataFrame:
    """Metrics of the test rows with the model kind and chosen setting."""
    s = run.setting
    chosen = {"learningRate": s.learning_rate, "maxDepth": s.max_depth, "numLeaves": s.num_leaves}
    text = ",".join(f"{k}={v}" for k, v in chosen.items() if v is not None)
    return run.metrics.select(F.lit(kind).alias("model"), F.lit(text).alias("best_setting"), *METRIC_COLS)


def best_setting(run: ForecastRun) -> str:
    """The chosen setting as ``name=value`` pairs in order of name."""
    scores = run.cv_model.avgMetrics
    better = max if run.cv_model.getEvaluator().isLargerBetter() else min
    chosen = run.cv_model.getEstimatorParamMaps()[scores.index(better(scores))]
    return ",".join(f"{p.name}={v}" for p, v in sorted(chosen.items(), key=lambda kv: kv[0].name))


def forecast_report(run: ForecastRun, kind: str) -> DataFrame:
    """Metrics of the test window with the model kind and chosen setting."""
    return run.metrics.select(F.lit(kind).alias("model"), F.lit(best_setting(run)).alias("best_setting"), *METRIC_COLS)


def scored_rows(run: ForecastRun) -> DataFrame:
    """The reference's scored table: (hour_ts, prediction, load, features)."""
    return run.test_scored.select("hour_ts", "prediction", LABEL, vector_to_array("features").alias("features"))


def single_fit_report(spark: SparkSession, sf_dir: str, num_trees: int = 40, seed: int = 42,
                      partitions: int = SERIES_PARTITIONS) -> DataFrame:
    """One forest pipeline fit on the training window (no CV), scored on the test window."""
    train, test = training_rows(spark, sf_dir)
    pipe = models.pipeline([models.forest(label=LABEL, features="features", num_trees=num_trees, seed=seed)])
    model = pipe.fit(by_key(train, ["hour_ts"], partitions))
    metrics = regression_metrics(model.transform(test), LABEL)
    return metrics.select(F.lit("forest_single_fit").alias("model"), *METRIC_COLS)
