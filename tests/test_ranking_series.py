"""Exact top items, ranking metrics, Lloyd's rounds, topic coherence and regular series against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilowatt.operators import clustering, learners, prep, ranking

FACTORS = "id long, features array<double>, score string"


def _factors(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r], None) for i, r in enumerate(rows)], FACTORS).repartition(3)


def _plain_top(users, items, n, first=0):
    out = {}
    for u, v in enumerate(users):
        order = sorted((-float(v @ w), first + i) for i, w in enumerate(items))[:n]
        out[u] = [(k, i) for k, (_, i) in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("block", [40, 1 << 16])
def test_top_items_are_those_of_all_pairs(spark, monkeypatch, block):
    """In several blocks too; few long items end most searches early, and equal items tie."""
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", block)
    monkeypatch.setattr(ranking, "STEP", 16)
    rng = np.random.default_rng(0)
    items = np.abs(rng.integers(-4, 5, (300, 6))) * np.where(np.arange(300) < 12, 30, 1)[:, None]
    items[50] = items[3]
    users = np.abs(rng.integers(-3, 4, (80, 6)))
    users[7] = 0
    df = _factors(spark, users).unionByName(spark.createDataFrame([(999, None, None), (None, [1.0] * 6, None), (998, [1.0], None)], FACTORS))
    got = ranking.top_items(df, _factors(spark, items, 1000), 5).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.user, r["rank"])):
        found.setdefault(r.user, []).append((r["rank"], r.item))
    assert found == _plain_top(users, items, 5, 1000)
    share = sum({r.user: r.compared for r in got}.values()) / (len(users) * len(items))
    assert share < 0.6


def test_few_or_no_items(spark):
    users = _factors(spark, np.eye(2))
    assert ranking.top_items(users, _factors(spark, np.eye(2)).limit(0), 3).collect() == []
    got = ranking.top_items(users, _factors(spark, np.array([[2.0, 1.0]]), 5), 3).collect()
    assert sorted((r.user, r["rank"], r.item, r.score) for r in got) == [(0, 1, 5, 2.0), (1, 1, 5, 1.0)]


def test_ranking_metrics_by_hand(spark):
    """Repeated pairs, ties, a user without a list and one without a relevant item."""
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.8), (1, 10, 0.1), (1, 13, 0.2), (2, 10, 1.0), (None, 1, 1.0), (3, 10, 0.5)], "u int, i int, s double")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (1, 12), (2, 50), (4, 10), (5, None)], "u int, i int")
    row = ranking.ranking_metrics(scored, relevant, "u", "i", "s", 3).first()
    # user 1: 10, 11, 12 of which the first and third are relevant; users 2 and 4: nothing
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert row.n_users == 3 and row.precision_at_k == pytest.approx(2 / 3 / 3)
    assert row.map_at_k == pytest.approx((1 + 2 / 3) / 3 / 3) and row.ndcg_at_k == pytest.approx((1 + 1 / math.log2(4)) / ideal / 3)
    assert ranking.ranking_metrics(scored, relevant.limit(0), "u", "i", "s", 3).first().n_users == 0


def test_ranking_metrics_partitions_follow_a_number(spark):
    """Adaptive execution merges by compressed bytes, so lists are dealt out by
    number; a user with many items in all hash parts is ranked right."""
    rows = [(u, (7 * i) % 301, float(i % 50)) for u, m in ((1, 300), (2, 3), (3, 40)) for i in range(m)]
    scored = spark.createDataFrame(rows, "u int, i int, s double")
    relevant = scored.where("i % 2 = 0").select("u", "i")
    got = ranking.ranking_metrics(scored, relevant, "u", "i", "s", 4, partitions=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 4 and "hashpartitioning(u#" in plan
    hits = [[i % 2 == 0 for _, i in sorted((-s, i) for v, i, s in rows if v == u)[:4]] for u in (1, 2, 3)]
    row = got.first()
    assert row.n_users == 3 and row.precision_at_k == pytest.approx(sum(map(sum, hits)) / 4 / 3)


def test_lloyd_rounds_are_numpys(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + 3])
    centers = np.array([[0.0, 0, 0], [1, 1, 1], [90, 90, 90]])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>")
    given = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cluster int, center array<double>")
    for rounds in (1, 4, 50):
        now = centers.copy()
        for _ in range(rounds):
            near = ((x[:, None, :] - now[None]) ** 2).sum(2).argmin(1)
            now = np.array([x[near == k].mean(0) if (near == k).any() else now[k] for k in range(3)])
        got = clustering.lloyd(df, "v", given, rounds).orderBy("cluster").collect()
        assert np.allclose([r.center for r in got], now, atol=1e-9)
    far = clustering.lloyd(df, "v", given, 50, tol=1e6).orderBy("cluster").collect()
    assert np.allclose([r.center for r in far], [r.center for r in clustering.lloyd(df, "v", given, 1).orderBy("cluster").collect()])


def test_coherence_by_hand(spark):
    docs = [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["b", "c"]), (4, ["a", "b", "c"]), (5, []), (6, None), (7, ["zz"])]
    df = spark.createDataFrame(docs, "doc int, words array<string>")
    terms = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("t", 4, "none"), ("one", 1, "c"), ("two", 1, "zz"), ("two", 2, "a")], "topic string, rank int, term string")
    got = {r.topic: (r.n_terms, r.coherence) for r in learners.coherence(df, "doc", "words", terms).collect()}
    t = math.log((2 + 1) / 3) + math.log((1 + 1) / 3) + math.log((2 + 1) / 3)  # a-b, a-c, b-c
    assert got["t"] == (3, pytest.approx(t)) and got["one"] == (1, 0.0) and got["two"] == (2, pytest.approx(math.log(1)))


@pytest.mark.parametrize("piece", [2, 4096])
@pytest.mark.parametrize("fill", [0.0, None])
def test_regular_series(spark, monkeypatch, piece, fill):
    """Gaps are filled between a key's first and last period, also over several pieces and for a null key."""
    monkeypatch.setattr(prep, "GRID_PIECE", piece)
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=h), float(h), 1) for h in (0, 1, 5, 9)] + [(None, start, 2.0, 3), (None, start + dt.timedelta(hours=2), None, 1)] + [("z", start, 1.0, 1), ("n", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double, n long")
    got = {(r.k, r.t): (r.v, r.n) for r in prep.regular(df, "t", "v", ["k"], fill=fill, counts=["n"]).collect()}
    want = {("a", start + dt.timedelta(hours=h)): (float(h), 1) if h in (0, 1, 5, 9) else (fill, 0) for h in range(10)}
    want |= {(None, start): (2.0, 3), (None, start + dt.timedelta(hours=1)): (fill, 0), (None, start + dt.timedelta(hours=2)): (None, 1), ("z", start): (1.0, 1)}
    assert got == want
    assert prep.regular(df.limit(0), "t", "v", ["k"]).collect() == [] and prep.regular(df.limit(0), "t", "v").collect() == []
    whole = prep.regular(df.where("k = 'a'"), "t", "v", unit="day").agg(F.count(F.lit(1))).first()[0]
    assert whole >= 1
