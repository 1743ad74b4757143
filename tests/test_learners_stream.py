"""Data-only workloads: learners, lexicon scoring, streaming k-means."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilowatt.operators import features, learners, models
from kilowatt.operators.graph import power_iteration
from kilowatt.operators.partitioning import by_key, materialize, spread_scan
from kilowatt.operators.text import lexicon_totals
from kilowatt.streaming.kmeans import stream_kmeans

# Inline ratings fixture (user, item, rating), in the shape of the
# reference's comma-separated sample.
RATINGS = [(1, 1, 5.0), (1, 2, 1.0), (1, 3, 5.0), (1, 4, 1.0), (2, 1, 5.0), (2, 2, 1.0), (2, 3, 5.0),
           (2, 4, 1.0), (3, 1, 1.0), (3, 2, 5.0), (3, 3, 1.0), (3, 4, 5.0), (4, 1, 1.0), (4, 2, 5.0),
           (4, 3, 1.0), (4, 4, 5.0)]


def test_isotonic_is_monotone_and_fits_pooled_means(spark):
    rows = [(1.0, 1.0), (3.0, 2.0), (2.0, 3.0), (4.0, 4.0), (6.0, 5.0), (5.0, 6.0)]
    df = spark.createDataFrame(rows, "y double, x double")
    model = learners.isotonic(df, "y", "x")
    curve = [(r["boundary"], r["prediction"]) for r in learners.isotonic_curve(model).collect()]
    preds = [p for _, p in curve]
    assert preds == sorted(preds)
    # PAV: (3, 2) pool to 2.5 at x=2,3 and (6, 5) pool to 5.5 at x=5,6
    got = {b: p for b, p in curve}
    assert got[2.0] == pytest.approx(2.5) and got[3.0] == pytest.approx(2.5)
    assert got[5.0] == pytest.approx(5.5)


def test_ridge_one_feature_closed_form(spark):
    rnd = random.Random(8)
    rows = [(float(x), 3.0 * x + rnd.gauss(0, 2)) for x in range(1, 200)]
    df = features.assemble(spark.createDataFrame(rows, "x double, y double"), ["x"])
    reg = 0.7
    m = models.linear("y", reg=reg, solver="normal").fit(df)
    n = len(rows)
    mx = sum(x for x, _ in rows) / n
    my = sum(y for _, y in rows) / n
    sxy = sum((x - mx) * (y - my) for x, y in rows)
    sxx = sum((x - mx) ** 2 for x, _ in rows)
    sy = (sum((y - my) ** 2 for _, y in rows) / n) ** 0.5
    slope = sxy / sxx / (1 + reg / sy)
    assert m.coefficients[0] == pytest.approx(slope, rel=1e-9)
    assert m.intercept == pytest.approx(my - slope * mx, rel=1e-9)


def test_als_top_items(spark):
    df = spark.createDataFrame(RATINGS, "user int, item int, rating double")
    model = learners.als(df, "user", "item", "rating", rank=2, max_iter=10, reg=0.01)
    top = learners.top_items(model, 2).collect()
    assert len(top) == 8
    best = {r["user"]: r["item"] for r in top if r["rank"] == 1}
    assert best[1] in (1, 3) and best[3] in (2, 4)


def test_pic_two_components(spark):
    # a triangle and a pair joined by one weak edge
    edges = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 0, 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    got = {r["id"]: r["cluster"] for r in learners.pic(df, "src", "dst", "w", k=2, max_iter=10).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0] == got[1] == got[2] and got[3] == got[4] and got[0] != got[3]


def test_pic_of_many_pairs_runs_as_joins(spark, monkeypatch):
    """A graph beyond the estimator's limit is not handed to it; the clusters are as good."""
    monkeypatch.setattr(learners, "PIC_PAIRS", 0)
    monkeypatch.setattr(learners, "PowerIterationClustering", None)
    edges = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 0, 0.1), (2, 2, 9.0), (7, 7, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    found = learners.pic(df, "src", "dst", "w", k=2, max_iter=10)
    assert found.dtypes == [("id", "bigint"), ("cluster", "int")]
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0] == got[1] == got[2] and got[3] == got[4] and got[0] != got[3]


@pytest.mark.parametrize("rounds, heavy", [(0, 100_000), (10, 5)])
def test_power_iteration_is_that_of_the_whole_matrix(spark, rounds, heavy):
    """Against the matrix: a hot node, pairs given twice and in both directions, nodes with themselves; the stopping rule."""
    rng = np.random.default_rng(3)
    pairs = [(0, int(b), float(w)) for b, w in zip(range(1, 60), rng.random(59))] + [
        (int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.random(200))]
    a = np.zeros((60, 60))
    for x, y, w in pairs:
        if x != y:
            a[x, y] += w
            a[y, x] += w
    degree = a.sum(1)
    v, before, change, least = degree / degree.sum(), np.inf, np.inf, 1e-5 / 60
    for _ in range(rounds):
        if change <= least:
            break
        new = a @ v / degree
        new /= np.abs(new).sum()
        delta = np.abs(new - v).sum()
        v, change, before = new, abs(delta - before), delta
    df = spark.createDataFrame(pairs, "src long, dst long, weight double").persist()
    got = {r["node"]: r["value"] for r in power_iteration(df, rounds, heavy).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(v.tolist(), rel=1e-12)


@pytest.mark.parametrize("bad", [(1, 2, -1.0), (1, 2, None), (None, 2, 1.0)])
def test_power_iteration_refuses_what_is_no_similarity(spark, bad):
    df = spark.createDataFrame([(0, 1, 1.0), bad], "src long, dst long, weight double")
    with pytest.raises(Exception, match="a pair must have two ids"):
        power_iteration(df, 2)


def test_lda_topics_name_the_frequent_terms(spark):
    docs = spark.createDataFrame([("apple banana apple fruit apple banana",), ("car engine wheel car car engine",)] * 20, "text string")
    tok = features.tokenize(docs, "text", "words")
    model = learners.lda(learners.hashed_counts(tok, "words", slots=64), k=2, max_iter=30, seed=3)
    top = learners.topics(model, tok, "words", 3).orderBy("topic", "rank").collect()
    assert [(r["topic"], r["rank"]) for r in top] == [(t, k) for t in (0, 1) for k in (1, 2, 3)]
    assert all(a["weight"] >= b["weight"] > 0 for a, b in zip(top, top[1:]) if a["topic"] == b["topic"])
    assert {r["term"] for r in top} >= {"apple", "car"}


def test_slot_terms_names_the_most_frequent_term_of_a_slot(spark):
    """With two slots every term shares one; each slot has its most frequent term."""
    words = ["a", "b", "c", "d", "e", "f"]
    tok = spark.createDataFrame([([w] * (i + 1),) for i, w in enumerate(words)], "words array<string>")
    hashed = learners.hashed_counts(spark.createDataFrame([([w],) for w in words], "words array<string>"), "words", slots=2)
    slot = {r["words"][0]: int(r["counts"].indices[0]) for r in hashed.collect()}
    got = {r["slot"]: r["term"] for r in learners.slot_terms(tok, "words", [0, 1], slots=2).collect()}
    assert got == {k: max(w for w in words if slot[w] == k) for k in set(slot.values())}


def test_slot_terms_counts_terms_in_batches(spark):
    """A row a term and batch is counted on, not a row an occurrence; counts of several
    batches add up, and null, empty and repeated arrays count as they did."""
    rows = [(["a", "b", "b"],), (None,), ([],), (["a"] * 5,), (["c", "b"],), (["b"] * 3,)] * 3
    tok = spark.createDataFrame(rows, "words array<string>").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        found = learners.slot_terms(tok, "words", [0], slots=1)
        assert [tuple(r) for r in found.collect()] == [(0, "a")]  # 18 times, as b: the first by name
    finally:
        spark.conf.set(name, old)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_isotonic_weights_repeated_values(spark):
    """Rows of one value count as often as they occur; nulls are left out."""
    rows = [(1.0, 1.0)] * 9 + [(11.0, 1.0), (1.0, 2.0), (None, 1.0), (5.0, None)]
    curve = learners.isotonic_curve(learners.isotonic(spark.createDataFrame(rows, "y double, x double"), "y", "x")).collect()
    assert {r["boundary"]: r["prediction"] for r in curve} == pytest.approx({1.0: 21 / 11, 2.0: 21 / 11})


def test_lexicon_totals_words_and_phrases(spark):
    docs = spark.createDataFrame([("a", "Not good at all"), ("a", "good good"), ("b", ""), ("b", None), (None, "all")], "source string, text string")
    lex = spark.createDataFrame([("good", 3), ("not good", -5), ("all", 1)], "term string, score long")
    got = {r["source"]: (r["n_docs"], r["total_score"], r["n_hits"]) for r in lexicon_totals(docs, lex, "source").collect()}
    assert got == {"a": (2, 3 - 5 + 1 + 6, 5), "b": (2, 0, 0), None: (1, 1, 1)}


def test_counted_terms_are_the_exploded_terms(spark):
    """Nulls, empty and blank texts, trailing blanks, groups over several batches; a text is split once."""
    from kilowatt.functions.text import java_tokens
    from kilowatt.operators.text import counted_terms, term_rows, terms_with_bigrams

    texts = ["a b a b a", "", " ", None, "B  b ", "x\ty\nx y", "a", "  a"]
    docs = spark.createDataFrame([(g, t) for g in ("s", None, "t") for t in texts], "source string, text string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        frame = counted_terms(docs, "source")
        got = {(r["source"], r["__term"]): r["n"] for r in frame.groupBy("source", "__term").agg(F.sum("__n").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    every = docs.select("source", F.explode(terms_with_bigrams(java_tokens("text"))).alias("term")).groupBy("source", "term").count()
    assert got == {(r["source"], r["term"]): r["count"] for r in every.collect()}
    assert got == {(r["source"], r["__term"]): r["count"] for r in term_rows(docs, "source").groupBy("source", "__term").count().collect()}


def test_spread_scan_and_materialize(spark):
    df = spark.range(0, 1000).coalesce(1)
    assert spread_scan(df, 32).rdd.getNumPartitions() == 32
    wide = spark.range(0, 1000).repartition(8)
    assert spread_scan(wide, 32) is wide
    m = materialize(df.withColumn("x", F.col("id") * 2))
    assert m.agg(F.sum("x")).first()[0] == 999 * 1000


@pytest.mark.parametrize("kind", ["forest", "gbt"])
def test_a_model_does_not_depend_on_the_inputs_partitions(spark, kind):
    """Folds, bootstraps and split candidates come from the rows' keys and the
    given layout: 1, 4 and 16 input partitions give one model."""
    from kilowatt.operators import splits, tuning
    from kilowatt.operators.metrics import regression_metrics

    rnd = random.Random(4)
    rows = [(i, float(rnd.random()), float(rnd.random())) for i in range(600)]
    base = spark.createDataFrame(rows, "k long, a double, b double").withColumn("load", F.col("a") * 3 + F.col("b") * F.col("b"))
    found = set()
    for n in (1, 4, 16):
        data = features.assemble(base.repartition(n, F.rand(n)), ["a", "b"]).select("k", "load", "features")
        train, test = splits.random_split(data, [0.7, 0.3], 5, "k")
        train = by_key(splits.with_folds(train, 3, "k", seed=5), ["k"], 4)
        est = models.forest(num_trees=6, seed=5) if kind == "forest" else models.gbt(max_iter=3, seed=5)
        cv = tuning.cross_validate(est, tuning.grid({est.maxDepth: [2, 3]}), tuning.regression_evaluator(), train, 3, "fold", 2)
        m = regression_metrics(cv.transform(test), "load").first()
        found.add((m["n"], round(m["rmse"], 9), round(m["r2"], 9), *(round(x, 9) for x in cv.avgMetrics)))
    assert len(found) == 1


def _batch_update(centers, weights, points, decay=1.0):
    sums = {i: [0.0] * len(centers[0]) for i in range(len(centers))}
    counts = {}
    for p in points:
        c = min(range(len(centers)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centers[i])), i))
        counts[c] = counts.get(c, 0) + 1
        sums[c] = [s + v for s, v in zip(sums[c], p)]
    centers = [list(c) for c in centers]
    weights = list(weights)
    for c, m in counts.items():
        n = weights[c] * decay
        centers[c] = [(cv * n + sv) / (n + m) for cv, sv in zip(centers[c], sums[c])]
        weights[c] = n + m
    return centers, weights


def test_stream_kmeans_matches_batch_updates_and_resumes(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    batches = [[[0.0, 0.0], [0.2, 0.0], [9.0, 9.0]], [[10.0, 10.0], [0.1, 0.3]]]
    for i, pts in enumerate(batches):
        spark.createDataFrame([(float(i * 10 + j), p) for j, p in enumerate(pts)], "id double, x array<double>") \
            .coalesce(1).write.parquet(f"{src}/b{i}")
    init = [[1.0, 1.0], [8.0, 8.0]]
    work = f"{tmp_dir}/work"
    glob = f"{src}/b*/*.parquet"
    out = stream_kmeans(spark, glob, "id double, x array<double>", "x", init, work_dir=work)
    got = {(r["cluster"], r["slot"]): r["value"] for r in out.collect()}
    # one file per trigger, oldest first (b0 was written first)
    c, w = [list(x) for x in init], [0.0, 0.0]
    for pts in batches:
        c, w = _batch_update(c, w, pts)
    for i in range(2):
        for j in range(2):
            assert got[(i, j)] == pytest.approx(c[i][j], rel=1e-12)
    # a second run over the same checkpoint applies nothing twice
    again = {(r["cluster"], r["slot"]): r["value"] for r in
             stream_kmeans(spark, glob, "id double, x array<double>", "x", init, work_dir=work).collect()}
    assert again == got


def _lose(file, folder):
    """Take a stream's file and its checksum away, as if it had never been written."""
    import os

    name = os.path.basename(file)
    for each in (file, os.path.join(os.path.dirname(file), f".{name}.crc")):
        if os.path.exists(each):
            os.rename(each, f"{folder}/lost-{os.path.basename(each)}")


def test_stream_kmeans_killed_between_state_and_commit(spark, tmp_dir):
    """A batch whose state is written but whose commit is lost is not applied twice."""
    import glob
    import os

    src, work = f"{tmp_dir}/src", f"{tmp_dir}/work"
    for i, pts in enumerate([[[0.0], [2.0]], [[10.0]]]):
        spark.createDataFrame([(float(i), p) for p in pts], "id double, x array<double>").coalesce(1).write.parquet(f"{src}/b{i}")
    run = lambda: {r["cluster"]: (r["value"], r["weight"]) for r in stream_kmeans(
        spark, f"{src}/b*/*.parquet", "id double, x array<double>", "x", [[1.0], [9.0]], work_dir=work).collect()}
    first = run()
    newest = max(glob.glob(f"{work}/checkpoint/commits/*"), key=lambda p: int(os.path.basename(p)))
    _lose(newest, tmp_dir)
    assert run() == first == {0: (1.0, 2.0), 1: (10.0, 1.0)}


def test_stream_state_that_cannot_be_read_is_an_error(spark, tmp_dir):
    from kilowatt.streaming.kmeans import _load_state

    assert _load_state(spark, f"{tmp_dir}/nothing") is None
    import os

    os.makedirs(f"{tmp_dir}/state")
    with open(f"{tmp_dir}/state/part-0.parquet", "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception):
        _load_state(spark, f"{tmp_dir}/state")


def test_stream_lexicon_restarts_after_a_kill(spark, tmp_dir):
    """Batches one by one, a lost commit, and a batch folder half written."""
    import glob
    import os

    from kilowatt.streaming.sentiment import stream_lexicon_totals

    src, work = f"{tmp_dir}/src", f"{tmp_dir}/work"
    lex = spark.createDataFrame([("good", 2)], "term string, score long")
    schema = "source string, text string"

    def run():
        return {r["source"]: (r["n_docs"], r["total_score"], r["n_hits"]) for r in stream_lexicon_totals(
            spark, f"{src}/b*/*.parquet", schema, lex, "source", work_dir=work).collect()}

    def add(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{i}")

    add(0, [("a", "good"), ("b", "bad")])
    assert run() == {"a": (1, 2, 1), "b": (1, 0, 0)}
    add(1, [("a", "good good")])
    assert run() == {"a": (2, 6, 3), "b": (1, 0, 0)}
    newest = max(glob.glob(f"{work}/checkpoint/commits/*"), key=lambda p: int(os.path.basename(p)))
    _lose(newest, tmp_dir)
    assert run() == {"a": (2, 6, 3), "b": (1, 0, 0)}


def test_scoring_stream_uses_the_newest_centers_and_restarts(spark, tmp_dir):
    """Rows are those of a batch computation; a batch whose commit is lost is scored again, not twice."""
    import glob
    import os

    from kilowatt.streaming.kmeans import score_stream

    src, test, model, work = (f"{tmp_dir}/{x}" for x in ("src", "test", "model", "work"))
    schema = "id long, x array<double>"
    spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [10.0])], schema).coalesce(1).write.parquet(f"{src}/b0")
    with pytest.raises(Exception, match="no centers"):
        spark.createDataFrame([(9, [0.0])], schema).coalesce(1).write.parquet(f"{test}/b0")
        score_stream(spark, f"{test}/b*/*.parquet", schema, "x", model, work_dir=f"{tmp_dir}/none")
    stream_kmeans(spark, f"{src}/b*/*.parquet", schema, "x", [[1.0], [9.0]], work_dir=model)
    run = lambda: sorted(tuple(r) for r in score_stream(spark, f"{test}/b*/*.parquet", schema, "x", model, work_dir=work).select("id", "cluster", "model_batch").collect())
    assert run() == [(9, 0, 0)]
    spark.createDataFrame([(3, [30.0])], schema).coalesce(1).write.parquet(f"{src}/b1")
    stream_kmeans(spark, f"{src}/b*/*.parquet", schema, "x", [[1.0], [9.0]], work_dir=model)  # the second center goes to 20
    spark.createDataFrame([(10, [9.0]), (11, [12.0]), (12, None)], schema).coalesce(1).write.parquet(f"{test}/b1")
    want = [(9, 0, 0), (10, 0, 1), (11, 1, 1), (12, None, 1)]
    assert run() == want
    newest = max(glob.glob(f"{work}/checkpoint/commits/*"), key=lambda p: int(os.path.basename(p)))
    _lose(newest, tmp_dir)
    assert run() == want
