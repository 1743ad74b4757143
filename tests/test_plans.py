"""Plan shapes that matter at scale: shuffles, pushdown, pruning.

These guard the physical plans the operators were designed for, so a
change that adds a shuffle or loses a pushed filter fails here.
"""

import re

from kilowatt.plans import catalog as C
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
                          plan))


def test_word_count_one_shuffle_after_partial_aggregation(spark):
    # the documents scan is spread round-robin when small; then explode,
    # partial count, one hash exchange on the word, final count
    plan = _plan(C.q_word_count(spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(word", plan)) == 1
    assert "partial_count" in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_lag_single_scan_two_shuffles(spark):
    plan = _plan(C.q_lag_24_48(spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1
    assert _shuffles(plan) == 2
    assert "BroadcastExchange" not in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(C.q_filter_half_open(spark, SF_SMALL))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed
    plan = _plan(C.q_split_time(spark, SF_SMALL))
    assert "LessThan(l_shipdate" in re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>", plan)


def test_asof_join_has_no_window_over_raw_rows_by_key_alone(spark):
    plan = _plan(C.q_asof_last_view(spark, SF_SMALL))
    # the only exchange feeding the big window is keyed by (user, bucket)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("user_id" in k and "__b" in k for k in keys)
    assert "EqualTo(event_type,click)" in plan and "EqualTo(event_type,view)" in plan
    # left and right are scanned once each beside the stored bucket summary (left
    # rows without key or time are a scan of their own that reads no such row)
    assert plan.count("FileScan parquet") <= 3


def test_assignment_is_a_single_map(spark):
    plan = _plan(C.q_assign_given_centers(spark, SF_SMALL))
    assert _shuffles(plan) == 0 and "BroadcastExchange" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lexicon_occurrences_are_counted_before_they_are_shuffled(spark):
    plan = _plan(C.q_sentiment_by_source(spark, SF_SMALL))
    assert re.search(r"partial_count[^\n]*\n(?:[^\n]*\n){0,3}?[^\n]*Generate explode", plan)


def test_time_window_reaches_the_scan(spark):
    plan = _plan(C.q_persistence_metrics(spark, SF_SMALL))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in pushed and "LessThan(ts,2024-01-31T00:00)" in pushed
    assert plan.count("FileScan parquet") == 1
    panel = _plan(C.fc.load_series(spark, SF_SMALL))
    assert "LessThan(ts,2024-01-31T00:00)" in panel and panel.count("FileScan parquet") == 1


def test_pagerank_rounds_do_not_shuffle_the_links(spark, monkeypatch):
    """Broadcasts off, as at size: in the plan of a round the persisted links are
    read without an exchange over them, and nothing is joined on src alone."""
    from kilowatt.operators import graph

    seen = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (seen.append(_plan(df)), real(df))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(0, 400).selectExpr("id % 7 AS src", "id AS dst")
        graph.pagerank(edges, rounds=1, heavy_degree=10).count()
        links = _plan(graph.salted_links(edges.distinct(), 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    round_plan = seen[-1].split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in round_plan
    branch = round_plan[:round_plan.index("InMemoryTableScan")].splitlines()
    join = max(i for i, line in enumerate(branch) if "SortMergeJoin" in line or "ShuffledHashJoin" in line)
    assert not any("Exchange" in line for line in branch[join:])
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", links)
    assert any("part" in keys for keys in joins)  # the edges meet their degree on (src, part)
    # the other join is over one row per (src, part), not over edges
    assert len(joins) == 2


def test_pagerank_edges_are_shuffled_once_and_never_sorted_again(spark, monkeypatch):
    """Broadcasts off, as at size: of the exchanges behind the persisted links one is over
    edges, and a round's join reads the links in the order they are kept in."""
    from kilowatt.operators import graph

    seen = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (seen.append(_plan(df)), real(df))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(0, 400).selectExpr("id % 7 AS src", "id AS dst")
        graph.pagerank(edges.union(edges), rounds=1, heavy_degree=10).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    round_plan, links = seen[-1].split("InMemoryRelation")[:2]
    branch = round_plan[:round_plan.index("InMemoryTableScan")].splitlines()
    join = max(i for i, line in enumerate(branch) if "SortMergeJoin" in line or "ShuffledHashJoin" in line)
    assert not any(re.search(r"\bSort\b", line) for line in branch[join:])
    exchanges = re.findall(r"\bExchange hashpartitioning\((\w+)#\d+L?, (\w*)", links)
    assert exchanges == [("src", "salt")]
