"""Leaf-wise boosting against plain trees, node tables against models and DuckDB, folds by subtraction."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kilowatt.operators import boosting, features, models, splits, trees, tuning

NAMES = ["a", "b", "c"]


def _data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 3, n)]).astype(float)
    return x, np.sin(x[:, 0]) + x[:, 1] ** 2 + 3 * (x[:, 2] == 1) + 0.1 * rng.normal(size=n)


def _frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))],
                                 "id long, a double, b double, c double, label double, fold int")


def _best(x, r, rows, edges, least):
    """(gain, slot, edge) of the best split of some rows."""
    found = (0.0, 0, 0.0)
    for j, known in enumerate(edges):
        for e in known:
            left = rows & (x[:, j] <= e)
            right = rows & ~left
            if left.sum() >= least and right.sum() >= least:
                gain = r[left].sum() ** 2 / left.sum() + r[right].sum() ** 2 / right.sum() - r[rows].sum() ** 2 / rows.sum()
                if gain > found[0] + 1e-9:
                    found = gain, j, e
    return found


def _leaf_wise(x, y, setting, edges):
    """Predictions of plain leaf-wise boosting: split the leaf of the largest gain, one at a time."""
    score = np.full(len(y), y.mean())
    for _ in range(setting.rounds):
        r = y - score
        leaves = {1: np.ones(len(y), bool)}
        while len(leaves) < (setting.num_leaves or 10**9):
            open_leaves = [(_best(x, r, rows, edges, setting.min_rows), k) for k, rows in leaves.items() if k.bit_length() <= setting.max_depth]
            (gain, j, e), k = max(open_leaves, key=lambda b: b[0][0], default=((0.0, 0, 0.0), 1))
            if gain <= 1e-8:
                break
            rows = leaves.pop(k)
            leaves[2 * k], leaves[2 * k + 1] = rows & (x[:, j] <= e), rows & (x[:, j] > e)
        for rows in leaves.values():
            score[rows] += setting.learning_rate * r[rows].mean()
    return score


def _scored(df, fits, setting):
    start, nodes = fits.of(setting)
    return np.array([r.prediction for r in trees.score(df, trees.node_table(df.sparkSession, nodes), NAMES, start).orderBy("id").collect()])


SETTINGS = [boosting.Setting(3, 4, 0.3, 4), boosting.Setting(5, 7, 0.2, 3, 20), boosting.Setting(2, None, 0.5, 2)]


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_leaf_wise_trees_are_those_of_plain_growth(spark, monkeypatch, blocks):
    """Also where rows are in several blocks, whose histograms meet in a shuffle."""
    x, y = _data()
    x[:, 1] = x[:, 1].clip(-1.5, 1.5)
    df = _frame(spark, x, y).repartition(1 if blocks == "one" else 4)
    if blocks == "many":
        monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    fits = boosting.fit_many(df, NAMES, "label", SETTINGS, 3, "fold", max_bins=40)
    edges = [s.edges for s in fits.slots]
    for setting in SETTINGS:
        assert np.allclose(_scored(df, fits, setting), _leaf_wise(x, y, setting, edges), atol=1e-9)
    for setting, fold, found in fits.metrics():  # a fold's fit never sees its rows
        rows = np.arange(len(y)) % 3 != fold
        other = boosting.fit_many(df.where(F.col("fold") != fold), NAMES, "label", [setting], slots=fits.slots)
        apart = (y - _scored(df, other, setting))[~rows]
        assert found["rmse"] == pytest.approx((apart**2).mean() ** 0.5, rel=1e-9) and found["mae"] == pytest.approx(np.abs(apart).mean(), rel=1e-9)
        assert found["r2"] == pytest.approx(1 - (apart**2).sum() / ((y[~rows] - y[~rows].mean()) ** 2).sum(), rel=1e-9)
        break


def test_budget_is_kept_and_depth_too(spark):
    x, y = _data(400, 3)
    setting = boosting.Setting(4, 6, 0.1, 3)
    _, nodes = boosting.fit_many(_frame(spark, x, y), NAMES, "label", [setting]).of(setting)
    for t in range(3):
        leaves = [n[1] for n in nodes if n[0] == t and n[2] is None]
        assert len(leaves) <= 6 and max(leaves).bit_length() <= 5


def test_categories_are_divided_by_their_means(spark):
    """Two categories apart from the one between them: no threshold does that."""
    rows = [(i, float(i % 3), 0.0, 0.0, 10.0 if i % 3 == 1 else 0.0, i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double, fold int")
    setting = boosting.Setting(1, None, 0.1, 1, 1, "tree")
    fits = boosting.fit_many(df, NAMES, "label", [setting], max_categories=4)
    assert fits.slots[0].categories == (0.0, 1.0, 2.0)
    start, nodes = fits.of(setting)
    assert nodes[0][2:5] == (0, None, [0.0, 2.0])
    unseen = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 7.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "id long, a double, b double, c double")
    got = trees.score(unseen, trees.node_table(spark, nodes), NAMES, start).orderBy("id").collect()
    assert [r.prediction for r in got] == [0.0, 10.0, 10.0, 10.0]  # what is no category of the left goes right


def test_empty_null_and_flat_input(spark):
    setting = boosting.Setting(2, 3, 0.1, 2)
    df = _frame(spark, *_data(5))
    empty = boosting.fit_many(df.where("id < 0"), NAMES, "label", [setting], 3, "fold")
    assert empty.of(setting) == (0.0, []) and empty.metrics() == []
    assert trees.score(df, trees.node_table(spark, []), NAMES, 1.5).first().prediction == 1.5
    flat = df.withColumn("label", F.lit(2.0)).unionByName(df.withColumn("label", F.lit(None).cast("double")))
    start, nodes = boosting.fit_many(flat, NAMES, "label", [setting]).of(setting)
    assert start == 2.0 and [n[1] for n in nodes] == [1, 1]
    with pytest.raises(ValueError):
        boosting.fit_many(df, NAMES, "label", [boosting.Setting(40)])


def _duckdb_scores(x, nodes, weights):
    """Rows scored from a node table by a recursive query."""
    con = duckdb.connect()
    con.register("n", nodes)
    con.execute("CREATE TABLE r (id BIGINT, x DOUBLE[])")
    con.executemany("INSERT INTO r VALUES (?, ?)", [(i, r.tolist()) for i, r in enumerate(x)])
    con.execute("CREATE TABLE w (tree INT, weight DOUBLE)")
    con.executemany("INSERT INTO w VALUES (?, ?)", list(enumerate(weights)))
    return np.array(con.sql("""
        WITH RECURSIVE walk AS (
            SELECT r.id, r.x, t.tree, t.node FROM r, (SELECT tree, min(node) AS node FROM n GROUP BY tree) t
            UNION ALL
            SELECT a.id, a.x, a.tree, CASE WHEN CASE WHEN n.threshold IS NULL THEN list_contains(n.categories, a.x[n.slot::BIGINT + 1]) ELSE a.x[n.slot::BIGINT + 1] <= n.threshold END
                                           THEN n."left" ELSE n."right" END
            FROM walk a JOIN n ON n.tree = a.tree AND n.node = a.node WHERE n.slot IS NOT NULL)
        SELECT sum(n.value * w.weight) FROM walk a JOIN n ON n.tree = a.tree AND n.node = a.node JOIN w ON w.tree = a.tree
        WHERE n.slot IS NULL GROUP BY a.id ORDER BY a.id""").df().iloc[:, 0])


def test_node_tables_of_models_give_their_predictions(spark):
    """A forest, boosted trees and a tree over indexed categories: by built-in expressions and by DuckDB."""
    x, y = _data(300, 5)
    df = _frame(spark, x, y)
    vec = features.assemble(df, NAMES)
    indexed = features.index_categories(vec, "features", "features2", max_categories=4)
    for est, rows in ((models.forest("label", "features", num_trees=5, max_depth=4), vec), (models.gbt("label", "features", max_iter=4, max_depth=3), vec),
                      (models.gbt("label", "features2", max_iter=3, max_depth=3), indexed.transform(vec))):
        model = est.fit(rows)
        want = np.array([r.prediction for r in model.transform(rows).orderBy("id").collect()])
        nodes, weights = trees.model_nodes(model), trees.model_weights(model)
        got = [r.prediction for r in trees.score(df, nodes, NAMES, weights=weights).orderBy("id").collect()]
        assert np.allclose(got, want, atol=1e-12)
        assert np.allclose(_duckdb_scores(x, nodes.toPandas(), weights), want, atol=1e-12)


def test_scoring_is_one_map(spark):
    x, y = _data(50)
    df = _frame(spark, x, y)
    setting = boosting.Setting(3, 4, 0.1, 2)
    start, nodes = boosting.fit_many(df, NAMES, "label", [setting]).of(setting)
    plan = trees.score(df, trees.node_table(spark, nodes), NAMES, start)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("reg", [0.0, 0.3])
def test_folds_by_subtraction_are_fits_of_their_own(spark, reg):
    """Against least squares of each training set in numpy; large values lose no digits."""
    x, y = _data(500, 7)
    y = 1e6 + 50 * y + 3 * x[:, 0]
    df = _frame(spark, x, y).unionByName(_frame(spark, x[:3], y[:3]).withColumn("a", F.lit(None).cast("double")))
    found = tuning.linear_cv(df, NAMES, "label", [(True, reg), (False, reg)], 3, "fold")
    fold = np.arange(500) % 3
    for (intercept, _), k in found.scores:
        train = fold != k
        mx, my = (x[train].mean(0), y[train].mean()) if intercept else (0, 0)
        a, b = x[train] - mx, y[train] - my
        w = np.linalg.solve(a.T @ a + reg * train.sum() * np.eye(3), a.T @ b)
        e = y[~train] - my - (x[~train] - mx) @ w
        have = found.scores[(intercept, reg), k]
        assert have["rmse"] == pytest.approx((e**2).mean() ** 0.5, rel=1e-7) and have["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-7)
        assert have["r2"] == pytest.approx(1 - (e**2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum(), rel=1e-7, abs=1e-7)
    assert found.best("rmse") == found.best("mse")


def test_folds_need_one_scan(spark):
    """Two jobs, whatever the number of settings and folds: the means, then the sums of every fold."""
    df = splits.with_folds(_frame(spark, *_data(100)).drop("fold"), 5, key="id")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "folds")
    tuning.linear_cv(df, NAMES, "label", [(True, r / 10) for r in range(6)], 5, "fold", mae=False)
    assert 0 < len(before.getJobIdsForGroup("folds")) <= 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    empty = tuning.linear_cv(df.where("id < 0"), NAMES, "label", [(True, 0.0)], 5, "fold")
    assert empty.scores == {}


def test_registered_grid_is_whole():
    from kilowatt.plans import forecast

    settings = forecast.boosted_settings("leaf_budget")
    assert len(settings) == 60 and {s.max_depth for s in settings} == set(range(3, 9)) and {s.rounds for s in settings} == {100}
    assert [s.rounds for s in forecast.boosted_settings("indexed_gbt")] == [300, 300]
