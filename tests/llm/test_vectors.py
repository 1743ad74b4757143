"""Vector near-duplicates and nearest neighbours against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kilowatt.llm import ann, queries, vector_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def _dup_brute(ids, rows, labels):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (unit @ unit.T >= vector_dedup.COSINE) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    component = ids.copy()
    while True:
        new = np.array([min([component[i], *component[near[i]]]) for i in range(len(ids))])
        if (new == component).all():
            return near.sum(1), component
        component = new


def _clustered(seed, n=900, d=24):
    """Spread vectors, chains of near copies, one large tight group and equal vectors."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d))
    rows[100:400] = rows[0] + 0.05 * rng.normal(size=(300, d))  # a hot group
    for i in range(400, 600):  # chains
        rows[i] = rows[i - 1] + 0.27 * rng.normal(size=d) if i % 5 else rows[i]
    rows[600:650] = rows[601]
    return np.arange(n) * 3, rows, np.where(np.arange(n) < 650, 1, rng.integers(0, 3, n))


@pytest.mark.parametrize("leaf", [64, 1024])
def test_links_are_those_of_all_pairs(spark, monkeypatch, leaf):
    """Also with leaves so small that the tight group cannot be split and is compared in blocks."""
    monkeypatch.setattr(vector_dedup, "LEAF", leaf)
    monkeypatch.setattr(vector_dedup, "BLOCK", leaf)
    ids, rows, labels = _clustered(1)
    df = spark.createDataFrame([(int(i), [float(x) for x in r], int(k)) for i, r, k in zip(ids, rows, labels)], SCHEMA)
    got = vector_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    links, component = _dup_brute(ids, rows, labels)
    assert (got.n_links.values <= links).all()  # never a link that is none
    assert got.n_links.sum() >= 0.999 * links.sum()
    assert (got.component_id.values == component).mean() > 0.999
    assert (got.kept == (got.vec_id == got.component_id)).all()


def _planted(spark, pairs):
    """Vectors 0 to pairs - 1, and one at a cosine of 0.932 for each."""
    rng = np.random.default_rng(3)
    first, other = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, pairs, 64)))
    other -= (first * other).sum(1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    rows = np.concatenate([first, 0.932 * first + np.sqrt(1 - 0.932**2) * other])
    return spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], SCHEMA)


def test_work_of_a_large_label(spark, monkeypatch):
    """Pairs just above the threshold in a label cut into leaves as often as one of 160,000 vectors: every
    link is found, by comparing a tenth of all pairs at most."""
    pairs = 10_000
    monkeypatch.setattr(vector_dedup, "LEAF", 32)
    seen, leaves = [], vector_dedup._leaves
    monkeypatch.setattr(vector_dedup, "_leaves", lambda rows: seen.append(leaves(rows)) or seen[0])
    got = vector_dedup.near_duplicates(_planted(spark, pairs)).toPandas().sort_values("vec_id")
    work = seen[0].agg(F.sum(F.col("size") - 1).alias("compared"), F.count(F.lit(1)).alias("copies")).first()
    print(f"copies a vector {work['copies'] / 2 / pairs:.1f}, compared {work['compared'] / (2 * pairs) ** 2:.4f}, lost {(got.n_links != 1).sum() // 2}")
    assert (got.n_links == 1).all() and (got.component_id.values == np.arange(2 * pairs) % pairs).all()
    assert work["compared"] < 0.1 * (2 * pairs) ** 2


def test_trees_are_grown_only_where_they_are_less_work(spark, monkeypatch):
    """A label of some thousand vectors is compared whole: no tree, no copies, and no link is lost."""
    seen, leaves = [], vector_dedup._leaves
    monkeypatch.setattr(vector_dedup, "_leaves", lambda rows: seen.append(rows) or leaves(rows))
    monkeypatch.setattr(vector_dedup, "BLOCK", 500)
    got = vector_dedup.near_duplicates(_planted(spark, 1500)).toPandas().sort_values("vec_id")
    assert not seen and (got.n_links == 1).all() and (got.component_id.values == np.arange(3000) % 1500).all()


def test_links_of_split_labels_are_those_of_all_pairs(spark, monkeypatch):
    """Every label of more than a leaf is split here, and the tight group is a leaf of many blocks."""
    for name, value in (("LEAF", 128), ("BLOCK", 128), ("WHOLE", 0)):
        monkeypatch.setattr(vector_dedup, name, value)
    ids, rows, labels = _clustered(2)
    df = spark.createDataFrame([(int(i), [float(x) for x in r], int(k)) for i, r, k in zip(ids, rows, labels)], SCHEMA)
    got = vector_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    links, component = _dup_brute(ids, rows, labels)
    assert (got.n_links.values <= links).all() and got.n_links.sum() >= 0.999 * links.sum()
    assert (got.component_id.values == component).mean() > 0.999


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("sparse", [0, 10**6])
def test_tiles_of_a_leaf_are_its_pairs(monkeypatch, blocks, sparse):
    """Sparse and dense tiles, one block or several, copies of a vector, pairs that an earlier leaf has."""
    monkeypatch.setattr(vector_dedup, "TILE", 50)
    monkeypatch.setattr(vector_dedup, "SPARSE", sparse)
    ids, rows, _ = _clustered(4)
    ids, rows = ids[:650], rows[:650]
    block, count = ids // 3 % blocks, 1 + ids % 4
    leaves = [[5, 7] if i % 2 else [7, 9] for i in range(650)]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= vector_dedup.COSINE
    np.fill_diagonal(near, False)
    odd = np.arange(650) % 2 == 1
    links, edges = np.zeros(650, int), []
    for low in range(blocks):
        for high in range(low, blocks):
            own = np.flatnonzero((block == low) | (block == high))
            table = pa.table({"leaf": [7] * len(own), "low": [low] * len(own), "high": [high] * len(own), "block": block[own], "cid": ids[own],
                              "count": count[own], "vector": [rows[i].tolist() for i in own], "leaves": [leaves[i] for i in own]})
            out = vector_dedup._compare(table).to_pandas()
            links[out.a[out.b.isna()].values // 3] += out.links[out.b.isna()].values
            edges += out[out.b.notna()][["a", "b"]].astype(int).values.tolist()
    assert (links == (near & ~(odd[:, None] & odd[None, :])) @ count).all()  # two odd ones meet in leaf 5
    component = np.arange(650)
    for _ in range(650):
        for a, b in edges:
            component[[a // 3, b // 3]] = component[[a // 3, b // 3]].min()
    assert (ids[component] == _dup_brute(ids, rows, np.zeros(650))[1]).all()


def test_vector_edges(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, v, 1), (1, v, 1), (2, [2.0, 4.0, 0.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1),
            (8, [1.0, None, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, [], 1), (None, v, 1), (None, None, 1), (11, [1e-200, 2e-200, 0.0], 1), (12, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("cid", F.lit(1)).withColumn("count", F.lit(1))
    got = vector_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr)
    linked = [(False, 1, 4, 1, True)] * 2 + [(False, 2, 4, 1, False), (True, 0, 4, 1, False), (False, 11, 4, 1, False)]
    alone = [(False, i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)] + [(True, 0, 0, None, False)]
    assert by == sorted(linked + alone, key=repr)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def _check_nearest(got, ids, rows, queries_, k):
    by = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    hit = total = 0
    for q in queries_:
        apart = np.sqrt(((rows - rows[ids == q][0]) ** 2).sum(1))
        other = ids != q
        order = np.lexsort((ids[other], apart[other]))[:k]
        want = ids[other][order]
        mine = by[q]
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        assert all(apart[ids == v][0] == s for v, s in zip(mine.vec_id, mine.score))
        pairs = list(zip(mine.score, mine.vec_id))
        assert pairs == sorted(pairs)
        hit += len(set(want) & set(mine.vec_id))
        total += len(want)
    return hit / total


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(0)
    rows = np.round(rng.normal(size=(300, 4)), 1)  # many ties
    ids = np.arange(300)
    df = spark.createDataFrame([(int(i), [float(x) for x in r], 0) for i, r in zip(ids, rows)], SCHEMA)
    usable = np.abs(rows).sum(1) > 0
    got = ann.search(df, F.col("id") % 7 == 0, k=5).toPandas()
    asked = [i for i in ids[usable] if i % 7 == 0]
    assert _check_nearest(got, ids[usable], rows[usable], asked, 5) == 1.0


def test_recall_through_the_forest(spark, monkeypatch):
    """With limits that make the search open half of the leaves only."""
    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 16))
    forest = ann.Forest(rows, leaf=ann.LEAF)
    opened = forest.search(rows[0], least=100)
    assert len(opened) < len(forest.members) / 2
    ids = np.arange(3000)
    monkeypatch.setattr(ann.Forest.search, "__defaults__", (ann.SHARE, 100))
    df = spark.createDataFrame([(int(i), [float(x) for x in r], 0) for i, r in zip(ids, rows)], SCHEMA)
    got = ann.search(df, F.col("id") % 100 == 0).toPandas()
    assert _check_nearest(got, ids, rows, [i for i in ids if i % 100 == 0], 10) >= 0.9


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows, ids = np.array(table.embedding.tolist(), float), table.vec_id.values
    got = queries.op10_ann(spark, sf).toPandas()
    assert _check_nearest(got, ids, rows, [i for i in ids if i % 100 == 0], 10) >= 0.9


@pytest.mark.parametrize("hot", [False, True])
def test_query_recall_on_a_table_larger_than_the_sample(spark, tmp_dir, hot):
    """The registered query and its parameters, also with a third of the rows equal."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(25_200, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids = np.arange(len(rows))
    copies = (ids % 3 == 1) & hot
    rows[copies] = rows[1]
    made = pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(rows)), "label": pa.array(np.zeros(len(ids), np.int32))})
    pq.write_table(made, f"{tmp_dir}/embeddings.parquet", row_group_size=4096)
    got = queries.op10_ann(spark, tmp_dir).toPandas()
    asked = ids[ids % 100 == 0]
    assert _check_nearest(got, ids, rows, asked[~copies[asked]], 10) >= 0.9
    if hot:
        assert _check_nearest(got, ids, rows, asked[copies[asked]], 10) == 1.0


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [5.0, 5.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (None, [1.0, 0.1], 0),
            (100, [1.0, 0.0], 0), (5, [1.0, 2.0, 3.0], 0), (200, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("rank", F.lit(9))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("id") % 100 == 0).collect()}
    assert got == {(0, 1, 100, 0.0), (0, 2, 1, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 1.0)}
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(120)], SCHEMA)
    got = ann.search(same, F.col("id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 11))
