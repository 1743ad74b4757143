"""Every registered query runs on sf0.001; those with SQL match DuckDB, the others
have their values checked."""

import dataclasses
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from kilowatt.plans import catalog as C
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
# Full grids of boosted trees take minutes; test_boosted_forecasts runs the same path on one setting.
SLOW = set(C.SLOW)


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def _count(con, sql):
    return con.execute(sql).fetchall()[0][0]


def _split(got, con):
    assert set(got.split) == {"train", "test"} and len(got) == _count(con, "SELECT COUNT(*) FROM lineitem")
    assert abs((got.split == "train").mean() - 0.7) < 0.03


def _metrics(got, con):
    row = got.iloc[0]
    assert len(got) == 1 and row.n > 0 and 0 <= row.mae <= row.rmse and row.rmse ** 2 == pytest.approx(row.mse)
    assert row.r2 < 1 and (row.r2 > -1 or row.n < 50)


def _predictions(got, con):
    low, high = con.execute("SELECT MIN(s), MAX(s) FROM (SELECT SUM(value) AS s FROM events GROUP BY date_trunc('hour', ts))").fetchall()[0]
    assert got.hour_ts.is_unique and got.prediction.between(low, high).all() and {len(f) for f in got.features} == {8}
    assert (got.hour_ts >= pd.Timestamp(C.fc.T_TEST)).all() and (got.hour_ts < pd.Timestamp(C.fc.T_END)).all()
    assert np.abs(got.prediction - got.load).mean() < np.abs(got.load.mean() - got.load).mean() * 1.5


def _params(got, con):
    assert int(dict(zip(got.param, got.value))["numTrees"]) in C.fc.FOREST_NUM_TREES


def _dump(got, con):
    lines = got.sort_values("line_no").line.tolist()
    assert "RandomForestRegressionModel" in lines[0]
    assert sum(line.strip().startswith("Tree ") for line in lines) in C.fc.FOREST_NUM_TREES


def _centers(got, con):
    points = np.array([r[0] for r in con.execute("SELECT embedding FROM embeddings").fetchall()], float)
    centers = got.pivot(index="cluster", columns="slot", values="value").values
    assert centers.shape == (10, points.shape[1])
    cost = ((points[:, None] - centers[None]) ** 2).sum(2).min(1).sum()
    assert cost < ((points - points.mean(0)) ** 2).sum()


def _stream_centers(got, con):
    _centers(got, con)
    assert got.drop_duplicates("cluster").weight.sum() == _count(con, "SELECT COUNT(*) FROM embeddings")


def _silhouette(got, con):
    assert got.n[0] == _count(con, "SELECT COUNT(*) FROM embeddings") and got.k[0] <= 10 and -1 <= got.silhouette[0] <= 1


def _auc(got, con):
    assert 0.7 < got.auc[0] <= 1


def _topics(got, con):
    assert len(got) == 25 and got.term.str.len().gt(0).all()
    for _, t in got.sort_values("rank").groupby("topic"):
        assert t["rank"].tolist() == [1, 2, 3, 4, 5] and (t.weight.diff().dropna() <= 0).all() and (t.weight > 0).all()
    corpus = _count(con, "SELECT lower(string_agg(text, ' ')) FROM documents")
    assert all(term in corpus for term in got.term)


def _items(got, con):
    buyers = _count(con, "SELECT COUNT(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    assert got.user.nunique() == buyers
    for _, u in got.sort_values("rank").groupby("user"):
        assert u["rank"].tolist() == list(range(1, len(u) + 1)) and u.item.is_unique and (u.score.diff().dropna() <= 1e-6).all()


def _clusters(got, con):
    nodes = _count(con, "SELECT COUNT(DISTINCT o_custkey) + COUNT(DISTINCT l_suppkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    assert got.id.is_unique and len(got) == nodes and set(got.cluster) <= {0, 1, 2} and {int(i) % 3 for i in got.id} == {0, 1}


def _curve(got, con):
    got = got.sort_values("boundary")
    assert got.prediction.is_monotonic_increasing
    low, high = con.execute("SELECT MIN(l_quantity), MAX(l_quantity) FROM lineitem").fetchall()[0]
    assert (got.boundary.min(), got.boundary.max()) == (low, high)


def _classes(got, con):
    assert ((got >= 0) & (got <= 1)).all().all()


CHECKS = {
    "split_random": _split, "forest_forecast_metrics": _metrics, "forest_random_split_metrics": _metrics, "panel_forecast_metrics": _metrics,
    "user_daily_forecast_metrics": _metrics, "single_fit_metrics": _metrics, "forecast_predictions": _predictions, "best_params": _params,
    "tree_dump": _dump, "kmeans_centers": _centers, "kmeans_text_vectors": _centers, "stream_kmeans": _stream_centers,
    "kmeans_silhouette": _silhouette, "text_quality_auc": _auc, "topics": _topics, "als_top_items": _items, "pic_clusters": _clusters,
    "isotonic_curve": _curve, "forest_classifier_metrics": _classes,
}


@pytest.mark.parametrize("name", sorted(set(C.queries()) - SLOW))
def test_query(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        CHECKS[name](got, con)
        return
    want = con.execute(sql).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_boosted_forecasts(spark, con, monkeypatch):
    """One setting and a few rounds of each boosted path: the queries leave both at the reference's."""
    monkeypatch.setattr(C.fc, "GBT_ROUNDS", 3)
    run = C.fc.forecast(spark, SF_SMALL, "gbt", axes_override={"maxDepth": [2]}, num_folds=2)
    _metrics(C.fc.forecast_report(run, "gbt").toPandas(), con)
    for kind in ("indexed_gbt", "leaf_budget"):
        settings = [dataclasses.replace(s, rounds=3) for s in C.fc.boosted_settings(kind)[:2]]
        run = C.fc.boosted_forecast(spark, SF_SMALL, kind, settings, folds=2)
        assert set(run.averages) == set(settings) and run.averages[run.setting] == min(run.averages.values())
        _metrics(C.fc.boosted_report(run, kind).toPandas(), con)


def test_grids_are_the_references():
    names = {k: {p.name: v for p, v in C.fc._estimator(k, 1)[2].items()} for k in ("forest", "gbt")}
    assert names["forest"] == {"numTrees": [60, 80]} and names["gbt"] == {"maxDepth": [5, 10]}
    assert C.fc._estimator("gbt", 1)[1].getMaxIter() == 20 and [C.fc._estimator(k, 1)[3] for k in ("forest", "gbt")] == [3, 3]
    assert {(s.max_depth, s.rounds) for s in C.fc.boosted_settings("indexed_gbt")} == {(8, 300), (9, 300)}
    leaf = C.fc.boosted_settings("leaf_budget")
    assert {s.max_depth for s in leaf} == {3, 4, 5, 6, 7, 8} and {s.num_leaves for s in leaf} == {16, 20, 31, 40, 60} and {s.learning_rate for s in leaf} == {0.05, 0.1}
    assert len(leaf) == 60 and {s.rounds for s in leaf} == {100} and (C.fc.CV_FOLDS, C.fc.LEAF_CV_FOLDS) == (3, 5)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "best_setting", "n", "rmse", "mse", "r2", "mae"]
    assert len(rows) == 1 and rows[0]["n"] > 0


def test_every_query_is_checked():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(C.queries()) - set(E.oracle_sql()) == set(CHECKS) | SLOW
