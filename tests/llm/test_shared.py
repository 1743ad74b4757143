"""Connected components: long chains, stars and look-ups of frequent keys."""

import math

import numpy as np
import pytest

from kilowatt.llm import shared


def _components(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(4)
    return {r.node: r.component for r in shared.connected_components(df).collect()}


def _plain(edges):
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch, broadcast):
    """A chain of random ids, whose edges no task contracts."""
    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    n, rounds, one = 256 if broadcast else 64, [], shared._round
    monkeypatch.setattr(shared, "_contract", lambda batches: batches)
    monkeypatch.setattr(shared, "TASK_EDGES", 16)
    monkeypatch.setattr(shared, "_round", lambda *args: rounds.append(1) or one(*args))
    ids = np.random.default_rng(1).permutation(10 * n)[:n].tolist()
    got = _components(spark, list(zip(ids, ids[1:], strict=False)))
    assert got == dict.fromkeys(ids, min(ids)) and len(rounds) <= 2 * math.log2(n)


@pytest.mark.parametrize("task_edges", [20, 1 << 16])
def test_stars_chains_and_pairs(spark, monkeypatch, task_edges):
    """By shuffles, with a center of a third of all edges, and in one task; nulls and loops are left out."""
    monkeypatch.setattr(shared, "TASK_EDGES", task_edges)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(shared, "HOT", 5)
    edges = [(500, k) for k in range(1, 120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000 + 2 * k, 2001 + 2 * k) for k in range(60)]
    want = _plain(edges)
    assert _components(spark, [*edges, (None, 3), (9000, 9000), (7, None)]) == want
    assert _components(spark, [(str(a), str(b)) for a, b in edges[:30]], "string") == {str(k): min(map(str, [500, *range(1, 31)])) for k in [500, *range(1, 31)]}
    assert _components(spark, []) == {}


def test_frequent_keys_are_not_gathered(spark, monkeypatch):
    """A third of the rows ask for one key: its row goes to them, and no shuffle has them."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(shared, "HOT", 10)
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k")
    table = spark.range(3000).selectExpr("id AS k", "id * 2 AS v")
    got = shared.look_up(rows, table, "k")
    assert sorted(tuple(r) for r in got.select("id", "v").collect()) == [(i, 0 if i % 3 == 0 else 2 * i) for i in range(3000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
