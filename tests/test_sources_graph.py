"""Sources and sinks round trips, PageRank and itemsets against brute force."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType, IntegerType

from kilowatt.operators.graph import pagerank
from kilowatt.operators.mining import frequent_itemsets
from kilowatt.sources import (
    read_pairs_text, scan_baskets, scan_csv, scan_delimited, scan_files, scan_labeled_rows, scan_libsvm,
    scan_number_rows, write_pairs_text,
)

# Inline fixtures (small ones from the reference's data folder, typed in).
FOLLOWERS = [(2, 1), (4, 1), (1, 2), (6, 3), (7, 3), (7, 6), (6, 7), (3, 7)]
BASKETS = ["r z h k p", "z y x w v u t s", "s x o n r", "x z y m t s q e", "z", "x z y r q t p"]
RATINGS = "0,0,1.0\n0,1,2.0\n1,1,3.0\n"


def _write(path, text):
    with open(path, "w", newline="") as fh:
        fh.write(text)
    return path


def test_csv_quoted_newline_and_empty(spark, tmp_dir):
    p = _write(f"{tmp_dir}/q.csv", 'id,name\n1,"a\nb"\n2,c\n')
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
    rows = scan_csv(spark, p, schema=schema, multiline=True).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "a\nb"), (2, "c")]
    inferred = scan_csv(spark, p, multiline=True)
    assert dict(inferred.dtypes)["id"] == "int"
    e = _write(f"{tmp_dir}/e.csv", "id,name\n")
    assert scan_csv(spark, e, schema=schema).count() == 0


def test_libsvm_sparse_rows(spark, tmp_dir):
    p = _write(f"{tmp_dir}/s.txt", "0 1:0.5 3:2\n1 2:1.5\n")
    df = scan_libsvm(spark, p, num_features=4).orderBy("label").collect()
    assert df[0]["features"].toArray().tolist() == [0.5, 0.0, 2.0, 0.0]
    assert df[1]["features"].toArray().tolist() == [0.0, 1.5, 0.0, 0.0]


def test_delimited_formats(spark, tmp_dir):
    r = _write(f"{tmp_dir}/r.data", RATINGS)
    df = scan_delimited(spark, r, ",", "user int, item int, rating double")
    assert df.count() == 3 and df.agg(F.sum("rating")).first()[0] == 6.0
    m = _write(f"{tmp_dir}/m.txt", "1::2::5::978300760\n3::4::1::978300761\n")
    mdf = scan_delimited(spark, m, "::", "user int, item int, rating int, ts long")
    assert [tuple(x) for x in mdf.orderBy("user").collect()] == [(1, 2, 5, 978300760), (3, 4, 1, 978300761)]
    n = _write(f"{tmp_dir}/n.txt", "0.0 0.0 0.0\n  0.1  0.1 0.1\n\n")
    assert [r["values"] for r in scan_number_rows(spark, n).collect()] == [[0.0, 0.0, 0.0], [0.1, 0.1, 0.1]]
    lp = _write(f"{tmp_dir}/l.data", "-0.4,2.8 -1.1\n0.5,1 2\n")
    got = [(r["label"], r["values"]) for r in scan_labeled_rows(spark, lp).collect()]
    assert got == [(-0.4, [2.8, -1.1]), (0.5, [1.0, 2.0])]
    b = _write(f"{tmp_dir}/b.txt", "\n".join(BASKETS) + "\n")
    assert scan_baskets(spark, b).count() == 6


def test_partitioned_files(spark, tmp_dir):
    for cls, date in [("kittens", "2018-01"), ("dogs", "2018-02")]:
        d = f"{tmp_dir}/tree/cls={cls}/date={date}"
        os.makedirs(d)
        _write(f"{d}/f.txt", "not an image")
    df = scan_files(spark, f"{tmp_dir}/tree", glob="*.txt", with_content=False)
    got = sorted((r["cls"], str(r["date"]), r["length"]) for r in df.collect())
    assert got == [("dogs", "2018-02", 12), ("kittens", "2018-01", 12)]
    pruned = df.where(F.col("cls") == "dogs")
    assert pruned.count() == 1


def test_pairs_text_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("a,b", 2), ("", 5), ("(x)", 1)], "word string, count long")
    path = f"{tmp_dir}/out"
    write_pairs_text(df, path, num_files=1)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1
    back = {r["word"]: r["count"] for r in read_pairs_text(spark, path).collect()}
    assert back == {"a,b": 2, "": 5, "(x)": 1}
    with pytest.raises(Exception):
        write_pairs_text(df, path)  # path exists


def _brute_pagerank(edges, rounds, d=0.85):
    edges = sorted(set(edges))
    nodes = {n for e in edges for n in e}
    out = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    r = {n: 1.0 for n in nodes}
    for _ in range(rounds):
        c = {n: 0.0 for n in nodes}
        for s, ts in out.items():
            for t in ts:
                c[t] += r[s] / len(ts)
        r = {n: (1 - d) + d * c[n] for n in nodes}
    return r


def test_pagerank_matches_brute_force(spark):
    df = spark.createDataFrame(FOLLOWERS, "src long, dst long")
    got = {r["node"]: r["rank"] for r in pagerank(df, rounds=7, checkpoint_every=2).collect()}
    expect = _brute_pagerank(FOLLOWERS, 7)
    assert got.keys() == expect.keys()
    for k in got:
        assert got[k] == pytest.approx(expect[k], rel=1e-12)


def test_pagerank_salted_hot_source(spark):
    """A source with most of the edges is salted; ranks stay exact."""
    edges = [(0, d) for d in range(1, 60)] + [(d, 0) for d in range(1, 60, 7)] + FOLLOWERS
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["rank"] for r in pagerank(df, rounds=4, heavy_degree=5).collect()}
    expect = _brute_pagerank(edges, 4)
    assert got.keys() == expect.keys()
    for k in got:
        assert got[k] == pytest.approx(expect[k], rel=1e-12)


def test_frequent_itemsets_small(spark):
    df = spark.createDataFrame([(b.split(),) for b in BASKETS], "items array<string>")
    model = frequent_itemsets(df, "items", min_support=0.5, min_confidence=0.6)
    sets = {",".join(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect()}
    # brute force over sizes 1-2
    from itertools import combinations

    baskets = [set(b.split()) for b in BASKETS]
    for size in (1, 2):
        for combo in combinations(sorted(set().union(*baskets)), size):
            c = sum(1 for b in baskets if set(combo) <= b)
            key = ",".join(combo)
            if c >= 3:
                assert sets[key] == c
            else:
                assert key not in sets


def test_baskets_are_collect_sets(spark):
    """Repeated and null items, a basket without an item, null keys, and baskets
    that reach over Arrow batches; equal baskets are fitted in one partition."""
    from kilowatt.operators.mining import baskets

    rows = [(k, f"i{(k * j) % 5}") for k in range(9) for j in range(k + 1)] + [(3, None), (20, None), (None, "x"), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "k long, item string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(sorted(r["items"]) for r in baskets(df, "k", "item").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expect = {}
    for k, item in rows:
        expect.setdefault(k, set()).update({item} - {None})
    assert got == sorted(sorted(v) for v in expect.values())
