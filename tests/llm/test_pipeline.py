"""The pipeline: every stage's decisions, the whole run by plain recomputation, odd input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from kilowatt.llm import minhash, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_registered():
    assert [k for k in queries.queries()] == [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.oracle_sql()) <= set(queries.queries())


def test_run_is_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["toxicity"] < corpus_pipeline.TOXIC}
    rest = docs.where(F.col("doc_id").isin(sorted(left)))
    scored = quality.score(rest, quality.fit(rest)).collect()
    left = sorted(r["doc_id"] for r in scored if r["quality_score"] >= quality.KEEP)
    # near-duplicates by comparing all pairs that share a shingle
    texts = pa.array([table[i] for i in left], pa.large_string())
    doc, element, weight = minhash.shingles(texts)
    ends = np.searchsorted(doc, np.arange(len(left) + 1))
    sets = [(element[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    members: dict = {}
    for d, e in zip(doc, element):
        members.setdefault(e, []).append(d)
    pairs = {(i, j) for m in members.values() for i in m for j in m if i < j}
    parent = list(range(len(left)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(pairs):
        if minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD - minhash.ROUNDING:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    want = {left[i] for i in range(len(left)) if find(i) == i}
    got = E.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == want
    whole = packing.pack(docs.where(F.col("doc_id").isin(sorted(want)))).select("doc_id", "doc_tokens").distinct().collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {tuple(r) for r in whole}
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in whole)


def test_stages_on_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, toxicity string, content string"
    text = "A plain sentence stands here and it has quite a few words."
    rows = [(1, text), (1, text), (2, text), (None, None), (3, None), (4, ""), (5, "word " * 20_000), (None, text + " And more of them."), (6, "x")]
    docs = spark.createDataFrame([(*r, None, None, None, "a", "b", "c") for r in rows], schema)
    for odd in (docs, docs.limit(0)):
        state = odd
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, SF)
            assert state.columns == docs.columns
            assert set(state.schema.fieldNames()) == set(docs.schema.fieldNames())
            state = state.cache()
            state.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, state, SF).collect()
        assert bool(pieces) == (odd is docs)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect() if r["text"] == text]
    assert kept == [1]
