"""Estimators, CV, and evaluators against closed forms and pyspark.ml."""

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kilowatt.functions.vectors import to_vector
from kilowatt.operators import clustering, features, metrics, models, tuning
from tests.conftest import SF_SMALL

# The six points of the reference's k-means sample, inlined.
KMEANS_POINTS = [
    (0.0, [0.0, 0.0, 0.0]), (1.0, [0.1, 0.1, 0.1]), (2.0, [0.2, 0.2, 0.2]),
    (3.0, [9.0, 9.0, 9.0]), (4.0, [9.1, 9.1, 9.1]), (5.0, [9.2, 9.2, 9.2]),
]


def test_kmeans_golden(spark):
    df = spark.createDataFrame([(lab, Vectors.dense(v)) for lab, v in KMEANS_POINTS], ["label", "features"])
    model = models.kmeans(k=2, seed=1).fit(df)
    pred = model.transform(df)
    sil = ClusteringEvaluator().evaluate(pred)
    assert sil == pytest.approx(0.9997530305375205, abs=1e-12)
    cs = sorted(round(c[0], 6) for c in model.clusterCenters())
    assert cs == [0.1, 9.1]
    assert model.summary.trainingCost == pytest.approx(0.12, abs=1e-9)
    table = clustering.centers(model).collect()
    assert len(table) == 6
    ours = metrics.silhouette(pred, "features", "prediction").first()["silhouette"]
    assert ours == pytest.approx(sil, abs=1e-12)


def test_silhouette_matches_evaluator_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    vec = emb.select(to_vector("embedding").alias("features"), F.col("label").cast("double").alias("prediction"))
    expect = ClusteringEvaluator().evaluate(vec)
    got = metrics.silhouette(emb, "embedding", "label").first()["silhouette"]
    assert got == pytest.approx(expect, abs=1e-9)


def test_assign_to_given_centers(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [2.4, 2.4])], "id int, x array<double>")
    cs = spark.createDataFrame([(7, [0.0, 0.0]), (9, [5.0, 5.0])], "cluster int, center array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.assign_to(pts, "x", cs, keys=["id"]).collect()}
    assert got == {1: 7, 2: 9, 3: 7}


def test_regression_metrics_match_evaluator(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, prediction double")
    got = metrics.regression_metrics(df, "y").first()
    for m in ("rmse", "mse", "r2", "mae"):
        ev = RegressionEvaluator(labelCol="y", predictionCol="prediction", metricName=m).evaluate(df)
        assert got[m] == pytest.approx(ev, rel=1e-9), m


def test_auc_matches_exact_evaluator(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.random() < 0.4), float(rnd.randint(0, 20))) for _ in range(2000)]  # heavy ties
    df = spark.createDataFrame(rows, "label double, score double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    got = metrics.auc(df, "label", "score", scores_per_range=3).first()["auc"]
    assert got == pytest.approx(ev, abs=1e-12)
    # brute force: P(s+ > s-) + 0.5 P(s+ == s-)
    pos = [s for y, s in rows if y == 1.0]
    neg = [s for y, s in rows if y == 0.0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(brute, abs=1e-12)


def test_classification_metrics_match_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rnd = random.Random(2)
    rows = [(float(rnd.randint(0, 2)), float(rnd.randint(0, 3))) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    got = metrics.classification_metrics(df, "label").first()
    names = {"accuracy": "accuracy", "weighted_precision": "weightedPrecision",
             "weighted_recall": "weightedRecall", "weighted_f1": "f1"}
    for ours, theirs in names.items():
        ev = MulticlassClassificationEvaluator(metricName=theirs).evaluate(df)
        assert got[ours] == pytest.approx(ev, abs=1e-12), ours


def _best_split(xs, ys):
    n, s = len(xs), sum(ys)
    pairs = sorted(zip(xs, ys))
    best = None
    nl = sl = 0
    for i, (x, y) in enumerate(pairs):
        nl += 1
        sl += y
        if i + 1 < n and pairs[i + 1][0] == x:
            continue
        if nl == n:
            break
        gain = sl * sl / nl + (s - sl) ** 2 / (n - nl)
        if best is None or gain > best[0]:
            best = (gain, x, sl / nl, (s - sl) / (n - nl))
    return best


@pytest.mark.parametrize("kind", ["forest", "gbt", "leaf_budget"])
def test_stumps_equal_best_split(spark, kind):
    rnd = random.Random(9)
    rows = [(float(rnd.randint(1, 30)), rnd.gauss(0, 1) + (5.0 if 0 else 0)) for _ in range(500)]
    rows = [(x, y + (3.0 if x > 17 else 0.0)) for x, y in rows]
    df = features.assemble(spark.createDataFrame(rows, "x double, y double"), ["x"])
    model = models.stump(kind, "y", "features", max_bins=64).fit(df)
    _, thr, ml, mr = _best_split([r[0] for r in rows], [r[1] for r in rows])
    for r in model.transform(df).select("x", "prediction").collect():
        expect = ml if r["x"] <= thr else mr
        assert r["prediction"] == pytest.approx(expect, rel=1e-9)


def test_leaf_budget_depth_and_grid_dedupe():
    assert models.leaf_budget_depth(8, 16) == 4
    assert models.leaf_budget_depth(3, 60) == 3
    assert models.leaf_budget_depth(8, 2) == 1
    est = models.leaf_budget_gbt()
    depths = sorted({models.leaf_budget_depth(d, n) for d in (3, 4, 5, 6, 7, 8) for n in (16, 20, 31, 40, 60)})
    maps = tuning.dedupe_grid(tuning.grid({est.maxDepth: depths, est.stepSize: [0.05, 0.1]}))
    assert len(maps) == 6  # the reference's 60 settings collapse to 6
    assert len(tuning.grid({est.maxDepth: [3, 4, 5, 6, 7, 8], est.stepSize: [0.05, 0.1],
                            est.maxBins: [16, 20, 31, 40, 60]})) == 60


def test_cv_closed_form_and_parallelism(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice")
    from kilowatt.operators import splits

    data = splits.with_folds(features.assemble(li, ["l_quantity"]), 3, key="l_orderkey").cache()
    est = models.linear("l_extendedprice")
    maps = tuning.grid({est.fitIntercept: [True, False]})
    ev = tuning.regression_evaluator("l_extendedprice", "rmse")
    m1 = tuning.cross_validate(est, maps, ev, data, 3, fold_col="fold", parallelism=1)
    m4 = tuning.cross_validate(est, maps, ev, data, 3, fold_col="fold", parallelism=4)
    assert m1.avgMetrics == pytest.approx(m4.avgMetrics, rel=1e-12)
    # closed form per fold, in Python
    rows = [(r["fold"], r["l_quantity"], r["l_extendedprice"]) for r in data.collect()]
    def rmse_for(intercept):
        out = []
        for f in range(3):
            tr = [(x, y) for g, x, y in rows if g != f]
            te = [(x, y) for g, x, y in rows if g == f]
            if intercept:
                n = len(tr); mx = sum(x for x, _ in tr) / n; my = sum(y for _, y in tr) / n
                b = sum((x - mx) * (y - my) for x, y in tr) / sum((x - mx) ** 2 for x, _ in tr); a = my - b * mx
            else:
                b = sum(x * y for x, y in tr) / sum(x * x for x, _ in tr); a = 0.0
            out.append(math.sqrt(sum((y - a - b * x) ** 2 for x, y in te) / len(te)))
        return sum(out) / 3
    assert m1.avgMetrics[0] == pytest.approx(rmse_for(True), rel=1e-9)
    assert m1.avgMetrics[1] == pytest.approx(rmse_for(False), rel=1e-9)
    res = tuning.cv_results(m1).collect()
    assert len(res) == 2
    assert tuning.best_params(m1).count() > 5


def test_forest_predictions_within_label_range_and_repeatable(spark):
    from kilowatt.plans import forecast as fc

    a = fc.forecast(spark, SF_SMALL, "forest", axes_override={"numTrees": [5]}, num_folds=2)
    b = fc.forecast(spark, SF_SMALL, "forest", axes_override={"numTrees": [5]}, num_folds=2)
    ma, mb = a.metrics.first(), b.metrics.first()
    assert ma["rmse"] == pytest.approx(mb["rmse"], rel=1e-12)
    lo, hi = fc.load_series(spark, SF_SMALL).agg(F.min("load"), F.max("load")).first()
    p = a.test_scored.agg(F.min("prediction"), F.max("prediction")).first()
    assert lo <= p[0] and p[1] <= hi
    dump = tuning.describe(tuning.best(a.cv_model)).count()
    assert dump > 3


def test_logistic_loss_decreases(spark):
    rnd = random.Random(4)
    rows = [(float(i % 2), Vectors.dense([rnd.gauss(i % 2, 1.0), rnd.gauss(0, 1)])) for i in range(300)]
    df = spark.createDataFrame(rows, ["label", "features"])
    model = models.logistic(max_iter=20).fit(df)
    hist = model.summary.objectiveHistory
    assert hist[-1] < hist[0]


def test_degenerate_inputs_give_null_not_errors(spark):
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, prediction double")
    r = metrics.regression_metrics(const, "y").first()
    assert r["r2"] is None and r["mse"] == pytest.approx(0.5)
    empty = spark.createDataFrame([], "y double, prediction double")
    assert metrics.regression_metrics(empty, "y").first()["rmse"] is None
    one = spark.createDataFrame([(1.0, 0.3), (1.0, 0.5)], "label double, score double")
    assert metrics.auc(one, "label", "score").first()["auc"] is None


@pytest.mark.parametrize("metric", ["mae", "r2"])
def test_selection_metric_and_depth_grid(spark, metric):
    """EST8 (forest depth grid) and EST9 (select by mae / r2): the chosen
    setting is the best mean metric in the chosen direction."""
    from kilowatt.plans import forecast as fc

    run = fc.forecast(spark, SF_SMALL, "forest", axes_override={"maxDepth": [2, 6]}, num_folds=2,
                      select_by=metric)
    avg = run.cv_model.avgMetrics
    best = max(range(len(avg)), key=lambda i: avg[i] if metric == "r2" else -avg[i])
    chosen = tuning.best(run.cv_model).getMaxDepth()
    assert chosen == [2, 6][best]


def test_two_column_assembly(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "temp int, t_m48 double")
    rows = features.assemble(df, ["temp", "t_m48"]).select("features").collect()
    assert [list(r["features"]) for r in rows] == [[1.0, 2.0], [3.0, 4.0]]


def test_deep_trees_cache_node_ids():
    deep = models.forest(max_depth=15)
    assert deep.getCacheNodeIds() and deep.getCheckpointInterval() == 10
    assert not models.gbt(max_depth=5).getCacheNodeIds()


def test_clusters_beyond_one_block_are_scored_alike(spark, monkeypatch):
    """Centers and statistics that are put into the plan in several blocks."""
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(3 * (i % 6), 1) for _ in range(4)], i % 6) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x array<double>, c int")
    from kilowatt.operators import clustering

    def both():
        cs = clustering.label_centers(df, "x", "c")
        return (metrics.silhouette(df, "x", "c").first()[0],
                {r["id"]: r["cluster"] for r in clustering.assign_to(df, "x", cs, keys=["id"]).collect()})

    whole = both()
    monkeypatch.setattr(metrics, "MAX_INLINE_VALUES", 8)
    cut = both()
    assert cut[0] == pytest.approx(whole[0], rel=1e-12) and cut[1] == whole[1]


def test_auc_over_many_ranges(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(float(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(2000)], "label double, score double")
    assert metrics.auc(df, "label", "score", scores_per_range=7).first()[0] == pytest.approx(metrics.auc(df, "label", "score").first()[0], rel=1e-12)
