"""Mixing sources to target weights: targets by fractions, budgets by all subsets."""

import itertools
import re
from fractions import Fraction

import numpy as np
import pytest

from kilowatt.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size string"


def _targets(sizes):
    """Water filling by fractions, sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in rest) if rest else 0
        new = {s for s in rest if share * weight[s] > 2 * sizes[s]}
        if not new:
            return {s: Fraction(2 * sizes[s]) if s in full else share * weight[s] for s in names}
        full |= new


def _check(got, rows):
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for k, (_, text, _, _) in enumerate(rows)}
    sizes, longest = {}, {}
    for k, (_, _, source, _) in enumerate(rows):
        sizes[source] = sizes.get(source, 0) + words[k]
        longest[source] = max(longest.get(source, 0), words[k])
    aims = _targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, words[k]) for k, r in enumerate(rows))
    for source, aim in aims.items():
        own = [r for r in got if r.source_size == sizes[source] and abs(r.target - float(aim)) < 1e-6]
        assert own
    assert all(r.taken % r["size"] == 0 and r.taken <= 2 * r["size"] if r["size"] else r.taken == 0 for r in got)
    return sizes, aims, longest


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sources_come_near_their_targets(spark):
    """A hot source whose documents mostly have one length, nulls, empty texts, repeated rows and a foreign column ``size``."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * (7 if rng.random() < 0.7 else int(rng.integers(1, 60)))), "hot", "x") for k in range(900)]
    rows += [(1000 + k, "a b\tc\x0bd\x1ce " * int(rng.integers(1, 30)), f"s{k % 5}", None) for k in range(400)]
    rows += [(2000, None, None, "x"), (2001, "", "s1", "x"), (2002, "one two", None, "x"), (2003, " \t\r\n", "empty", "x")]
    rows += [(None, "three words here", "s2", "x"), (1000, "a b", "s0", "x"), (1000, "a b", "s0", "x"), (2004, "é\xa0ñ x", "é", "x")]
    got = mixing.mix(_table(spark, rows)).collect()
    sizes, aims, longest = _check(got, rows)
    for source, aim in aims.items():
        own = [r for r in got if r.source_size == sizes[source] and abs(r.target - float(aim)) < 1e-6]
        same = [s for s in sizes if sizes[s] == sizes[source] and abs(float(aims[s] - aim)) < 1e-6]
        assert abs(sum(r.taken for r in own) - len(same) * float(aim)) <= max(1, longest[source])
    hot = [r for r in got if r.source_size == sizes["hot"]]
    assert abs(sum(r.taken for r in hot) - float(aims["hot"])) <= 1


def test_reruns_agree(spark):
    rows = [(k, "w " * (1 + k * 7919 % 23), f"s{k % 4}", None) for k in range(3000)]
    order = lambda df: sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect())
    first = order(_table(spark, rows))
    assert first == order(_table(spark, rows[::-1]).repartition(13))
    assert first != sorted((r.doc_id, r.taken) for r in mixing.mix(_table(spark, rows), seed=1).collect())


def test_large_plans_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(k, "w " * (5 if k % 3 else 1 + k % 40), f"s{k % 4}", None) for k in range(2000)]
    order = lambda: sorted((r.doc_id, r.taken) for r in mixing.mix(_table(spark, rows)).collect())
    first = order()
    monkeypatch.setattr(mixing, "PLAN_BYTES", 0)
    monkeypatch.setattr(mixing, "PLAN_ROWS", 10)
    assert first == order()


def test_one_length_is_never_ranked_in_one_task(spark):
    """A third of all documents are of one source and length: only the hash bucket of the cut is ranked."""
    rows = [(k, "w " * 5 if k < 4000 else "w " * (1 + k % 50), "a" if k < 4000 else f"s{k % 9}", None) for k in range(12000)]
    df = mixing.mix(_table(spark, rows))
    got = df.collect()
    hot = [r for r in got if r.source_size == 20000]
    assert len(hot) == 4000 and len({r.taken for r in hot}) <= 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "cut" in plan


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_against_all_subsets(seed):
    rng = np.random.default_rng(seed)
    size, free = np.unique(rng.integers(1, 40, 5))[::-1], None
    free = rng.integers(0, 4, len(size))
    left = int(rng.integers(1, 150))
    sums = {sum(int(n) * int(s) for n, s in zip(take, size, strict=True)) for take in itertools.product(*[range(f + 1) for f in free])}
    best = min(abs(s - left) for s in sums if s <= 2 * left)
    take = mixing.knapsack(size, free, left)
    assert (take <= free).all() and abs(int((take * size).sum()) - left) == best


def test_fit_with_large_budgets_and_coarse_units():
    length, count = np.array([1, 3, 50, 700, 40_000, 900_000]), np.array([10, 5, 4000, 9000, 300, 7])
    total = int((length * count).sum())
    for share in (0.01, 0.37, 0.999, 1.0, 1.2, 1.73, 2.0):
        passes, extra = mixing.fit(length, count, share * total)
        assert (extra <= count).all() and passes + bool(extra.any()) <= 2
        assert abs(passes * total + int((extra * length).sum()) - share * total) <= 1
    take = mixing.knapsack(np.array([5_000_003, 700]), np.array([3, 10]), 10_000_000, sums=1 << 12)
    assert list(take) == [2, 0]


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(_table(spark, [])).collect() == []
    got = mixing.mix(_table(spark, [(1, None, "a", None), (2, " ", None, None)])).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_query(spark):
    got = queries.op11_mixing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    docs = [(r.doc_id, r.text, r.source, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    _check(got.collect(), docs)
