"""The query catalog: one Spark query per operator, each over whole tables,
and (where SQL can express it) the equivalent DuckDB SQL.

Column names and rounding match between a query and its SQL, so results
compare row for row. Queries that write files use a fresh folder under the
session's shared checkpoint area.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilowatt.functions.text import java_tokens
from kilowatt.functions.vectors import to_array, to_vector
from kilowatt.operators import boosting, clustering, features, metrics, models, ranking, relational, splits, text, trees, tuning
from kilowatt.operators.graph import pagerank
from kilowatt.operators.mining import baskets, frequent_itemsets
from kilowatt.operators.partitioning import by_key, materialize, spread_scan, train_partitions
from kilowatt.operators.prep import asof_join, calendar, hourly, lag_by_time, regular
from kilowatt.plans import forecast as fc
from kilowatt.session import scratch_path
from kilowatt.sources import csv as csv_src
from kilowatt.sources import files as files_src
from kilowatt.sources import libsvm as libsvm_src
from kilowatt.sources import sinks
from kilowatt.sources.delimited import scan_delimited
from kilowatt.sources.text import scan_text

Query = Callable[[SparkSession, str], DataFrame]

# Time bounds of the lineitem filter queries (the reference's
# train/test month bounds, moved into lineitem's 1995-2001 ship dates).
T0 = "1999-06-01 00:00:00"
T1 = "1999-07-01 00:00:00"
T_LATE = "2001-07-31 00:00:00"
SEED = 7


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """documents, dealt out if one task would read them all (text work before
    the first shuffle is the expensive part)."""
    return spread_scan(_t(spark, sf_dir, "documents").select(*cols))


# --------------------------------------------------------------- sources

def q_csv_roundtrip(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    path = scratch_path(spark, "csv")
    csv_src.write_csv(orders, path)
    return csv_src.scan_csv(spark, path, schema=orders.schema, multiline=True)


def q_libsvm_roundtrip(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "libsvm")
    libsvm_src.write_libsvm(
        emb.select(F.col("label").cast("double").alias("label"), to_vector("embedding").alias("features")), path
    )
    back = libsvm_src.scan_libsvm(spark, path, num_features=64)
    return features.explode_vector(back, "features", ["label"]).select(
        "label", "slot", F.round("value", 6).alias("value")
    )


def q_word_count(spark, sf_dir):
    docs = _docs(spark, sf_dir, "text")
    return text.word_count(docs, "text", multiline_text=True)


def q_text_scan_word_count(spark, sf_dir):
    """The reference's word count as written: text files -> lines -> words.

    The documents are first written as text files (Spark writes each value
    followed by a newline), then scanned line by line."""
    path = scratch_path(spark, "text-src")
    _docs(spark, sf_dir, "text").where(F.col("text").isNotNull()).write.text(path)
    return text.word_count(scan_text(spark, path), "value")


def q_delimited_roundtrip(spark, sf_dir):
    """Multi-character separator (the ratings format), explicit schema."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "delimited")
    orders.write.option("sep", "::").csv(path)
    schema = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"
    return scan_delimited(spark, path, "::", schema)


def q_preview_lineitem(spark, sf_dir):
    """``show(10)`` made stable: the first 10 rows in a total order (a top-k;
    keys repeat in the data, so every shown column is part of the order)."""
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return sinks.preview(_t(spark, sf_dir, "lineitem").select(*cols), 10, order_by=cols)


def q_schema_table(spark, sf_dir):
    """printSchema of lineitem as rows, each with how many values the column holds."""
    li = _t(spark, sf_dir, "lineitem")
    values = li.agg(*[F.count(c).alias(c) for c in li.columns])
    counted = values.unpivot([], li.columns, "name", "n_values")
    return sinks.schema_table(li).select(F.col("column").alias("name"), "type").join(counted, "name")


def q_word_count_saved(spark, sf_dir):
    path = scratch_path(spark, "wordcount")
    sinks.write_pairs_text(q_word_count(spark, sf_dir), path)
    return sinks.read_pairs_text(spark, path)


def q_files_partitioned(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    path = scratch_path(spark, "files")
    orders.select(
        F.col("o_orderkey").cast("string").alias("value"), "o_orderstatus", "o_orderpriority"
    ).write.partitionBy("o_orderstatus", "o_orderpriority").text(path)
    # bytes from file metadata only (binaryFile skips content not selected);
    # lines from the splittable text reader, which discovers the same keys
    keys = ["o_orderstatus", "o_orderpriority"]
    sizes = files_src.scan_files(spark, path, glob="*.txt", with_content=False).groupBy(*keys).agg(
        F.sum("length").cast("long").alias("n_bytes")
    )
    lines = scan_text(spark, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(sizes, keys, "full_outer").select(*keys, "n_lines", "n_bytes")


# ------------------------------------------------- projection / filter / view

def q_project_view(spark, sf_dir):
    relational.register_view(_t(spark, sf_dir, "lineitem"), "kw_lineitem_all")
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM kw_lineitem_all"
    )


def q_filter_before(spark, sf_dir):
    return relational.before(_t(spark, sf_dir, "lineitem"), "l_shipdate", T0)


def q_filter_half_open(spark, sf_dir):
    relational.register_view(_t(spark, sf_dir, "lineitem"), "kw_lineitem_all")
    return spark.sql(
        f"SELECT * FROM kw_lineitem_all WHERE l_shipdate >= TIMESTAMP_NTZ '{T0}' "
        f"AND l_shipdate < TIMESTAMP_NTZ '{T1}'"
    )


def q_filter_after(spark, sf_dir):
    return relational.after(_t(spark, sf_dir, "lineitem"), "l_shipdate", T_LATE)


# ------------------------------------------------------------------ splits

def q_split_time(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return splits.with_time_split(li, "l_shipdate", T0, T1).select("l_orderkey", "l_linenumber", "split")


def q_split_key(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return splits.with_key_split(li, "l_orderkey", 10, 7).select("l_orderkey", "l_linenumber", "split")


def q_split_random(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return splits.with_random_split(li, [0.7, 0.3], SEED, ["l_orderkey", "l_linenumber"], ["train", "test"]).select(
        "l_orderkey", "l_linenumber", "split"
    )


# ------------------------------------------------------------- preparation

def _hourly_by_type(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_type", "ts", "value")
    return hourly(ev, "ts", "value", keys=["event_type"])


def q_hourly_load(spark, sf_dir):
    return _hourly_by_type(spark, sf_dir).select(
        "event_type", "hour_ts", F.round("load", 6).alias("load"), "n_events"
    )


def q_calendar_features(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", "ts")
    return calendar(ev, "ts").drop("ts")


def q_lag_24_48(spark, sf_dir):
    lagged = lag_by_time(_hourly_by_type(spark, sf_dir), "hour_ts", "load", (24, 48), keys=["event_type"])
    return lagged.select(
        "event_type", "hour_ts", F.round("load", 6).alias("load"), "n_events",
        F.round("t_m24", 6).alias("t_m24"), F.round("t_m48", 6).alias("t_m48"),
    )


def q_asof_last_view(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_event_id"),
        F.col("value").alias("view_value"),
    )
    return asof_join(clicks, views, "ts", "view_ts", keys=["user_id"], tiebreak="view_event_id")


# ---------------------------------------------------------------- features

ASSEMBLE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_assemble_slots(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *ASSEMBLE_COLS)
    vec = features.assemble(li, ASSEMBLE_COLS, "features")
    return features.explode_vector(vec, "features", ["l_orderkey", "l_linenumber"])


def _coded_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", -1.0).when(F.col("l_returnflag") == "N", 0.0)
        .otherwise(5.0).alias("flag_code"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(2.0).alias("status_code"),
        F.pmod(F.month("l_shipdate"), F.lit(3)).cast("double").alias("month_of_quarter"),
        "l_discount", "l_tax",
    )


INDEX_COLS = ["flag_code", "status_code", "month_of_quarter", "l_discount", "l_tax"]


def q_index_categories(spark, sf_dir):
    coded = features.assemble(_coded_lineitem(spark, sf_dir), INDEX_COLS, "features")
    model = features.index_categories(coded, "features", "indexed", max_categories=4)
    return features.explode_vector(model.transform(coded), "indexed", ["l_orderkey", "l_linenumber"])


# --------------------------------------------------------- metrics / models

def q_persistence_metrics(spark, sf_dir):
    out = fc.persistence_metrics(spark, sf_dir, keys=["event_type"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mse", "r2", "mae")])


def _stump_query(kind):
    def q(spark, sf_dir):
        li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        vec = features.assemble(li, ["l_quantity"], "features")
        model = models.stump(kind, "l_extendedprice", "features", max_bins=64).fit(vec)
        return model.transform(vec).select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))

    return q


LINEAR_SETTINGS = ((True, 0.0), (False, 0.0))


def _cv_linear(spark, sf_dir, mae=False):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    data = splits.with_folds(li, 3, key="l_orderkey")
    return tuning.linear_cv(data, ["l_quantity"], "l_extendedprice", LINEAR_SETTINGS, 3, "fold", mae)


def q_cv_results(spark, sf_dir):
    found = _cv_linear(spark, sf_dir)
    return spark.createDataFrame([(s[0], round(found.average(s, "rmse"), 4)) for s in LINEAR_SETTINGS], "fit_intercept boolean, avg_rmse double")


def q_cv_closed_form(spark, sf_dir):
    found = _cv_linear(spark, sf_dir)
    best = found.best("rmse")
    slope, intercept = found.fits[best, None]
    return spark.createDataFrame([(best[0], round(float(slope[0]), 4), round(intercept, 4))], "fit_intercept boolean, slope double, intercept double")


def q_assign_given_centers(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    cs = clustering.label_centers(emb, "embedding", "label")
    return clustering.assign_to(emb, "embedding", cs, keys=["vec_id"])


def q_silhouette_given_labels(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    return metrics.silhouette(emb, "embedding", "label").select(F.round("silhouette", 8).alias("silhouette"))


def q_classification_metrics(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    cs = clustering.label_centers(emb, "embedding", "label")
    pred = clustering.assign_to(emb, "embedding", cs, keys=["vec_id", "label"], out="prediction")
    out = metrics.classification_metrics(pred, "label", "prediction")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def q_auc_given_score(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_discount"
    )
    return metrics.auc(li, "label", "l_discount").select(F.round("auc", 8).alias("auc"))


# -------------------------------------------------------------------- text

def q_tokenize_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir, "text").where(F.col("text").isNotNull())
    tok = features.tokenize(docs, "text", "words")
    return tok.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def q_hash_tf_totals(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text").where(F.col("text").isNotNull())
    tf = features.hash_tf(features.tokenize(docs, "text", "words"), "words", "tf", num_features=1 << 10)
    total = F.aggregate(to_array("tf"), F.lit(0.0), lambda a, v: a + v)
    return tf.select("doc_id", total.cast("long").alias("n_terms"))


# ------------------------------------------------------------ tier C (data)

PAGERANK_ROUNDS = 5
# A node is its key times 3 plus its kind, so keys of any size stay apart.
CUSTOMER, SUPPLIER, NATION = 0, 1, 2


def _node(key, kind):
    return F.col(key).cast("long") * 3 + kind


def _commerce_edges(spark, sf_dir):
    """customer -> supplier it bought from -> supplier's nation -> customers there."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    bought = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        _node("o_custkey", CUSTOMER).alias("src"), _node("l_suppkey", SUPPLIER).alias("dst")
    )
    sup = _t(spark, sf_dir, "supplier").select(
        _node("s_suppkey", SUPPLIER).alias("src"), _node("s_nationkey", NATION).alias("dst")
    )
    cust = _t(spark, sf_dir, "customer").select(
        _node("c_nationkey", NATION).alias("src"), _node("c_custkey", CUSTOMER).alias("dst")
    )
    return bought.unionByName(sup).unionByName(cust)


def q_pagerank_5(spark, sf_dir):
    ranks = pagerank(_commerce_edges(spark, sf_dir), rounds=PAGERANK_ROUNDS)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


FP_MIN_SUPPORT = 0.01


FP_MIN_CONFIDENCE = 0.02


def _mined(spark, sf_dir, result):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # the fit counts items, the itemsets are mined when first read: keep the
    # baskets for both passes, write the (small) result, then let them go
    kept = baskets(li.join(part.hint("shuffle_hash"), li.l_partkey == part.p_partkey), "l_orderkey", "p_brand")
    # equal baskets meet in one partition: its trees then have a path for each
    # distinct basket, and trees, not baskets, are what is shuffled
    kept = kept.repartition("items").persist()
    model = frequent_itemsets(kept, "items", min_support=FP_MIN_SUPPORT, min_confidence=FP_MIN_CONFIDENCE, distinct=True)
    out = materialize(result(model))
    kept.unpersist()
    return out


def q_frequent_itemsets(spark, sf_dir):
    return _mined(spark, sf_dir, lambda model: model.freqItemsets.select(
        F.array_join(F.array_sort("items"), ",").alias("itemset"), F.col("freq").cast("long").alias("freq")))


def q_association_rules(spark, sf_dir):
    return _mined(spark, sf_dir, lambda model: model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"),
        F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"), F.round("support", 8).alias("support")))


# ------------------------------------------------- trained, rows-only checks

def _forecast_metrics(kind, name=None, **options):
    def q(spark, sf_dir):
        return fc.forecast_report(fc.forecast(spark, sf_dir, kind, **options), name or kind)

    return q


def q_forecast_predictions(spark, sf_dir):
    """The reference's scored table of the test window: prediction beside load."""
    return fc.scored_rows(fc.forecast(spark, sf_dir, "forest"))


def q_best_params(spark, sf_dir):
    return tuning.best_params(fc.forecast(spark, sf_dir, "forest").cv_model)


def q_tree_dump(spark, sf_dir):
    return tuning.describe(tuning.best(fc.forecast(spark, sf_dir, "forest").cv_model))


def q_kmeans_centers(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select(to_vector("embedding").alias("features"))
    model = models.kmeans(k=10, seed=1).fit(emb)
    return clustering.centers(model)


def q_kmeans_silhouette(spark, sf_dir):
    from pyspark.ml.evaluation import ClusteringEvaluator

    emb = _t(spark, sf_dir, "embeddings").select(to_vector("embedding").alias("features"))
    model = models.kmeans(k=10, seed=1).fit(emb)
    pred = model.transform(emb)
    sil = ClusteringEvaluator().evaluate(pred)
    return pred.groupBy().agg(
        F.lit(sil).alias("silhouette"), F.count(F.lit(1)).alias("n"), F.countDistinct("prediction").alias("k")
    )


def q_text_quality_auc(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text").where(F.col("text").isNotNull())
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    data = docs.join(labels, "doc_id")
    data = features.hash_tf(features.tokenize(data, "text", "words"), "words", "features", 1 << 12)
    train, test = splits.key_split(data, "doc_id", 10, 7)
    model = models.logistic("label", "features", max_iter=50, reg=0.01).fit(train)
    # score = probability of the positive class
    scored = model.transform(test).select("label", to_array("probability")[1].alias("score"))
    return metrics.auc(scored, "label", "score")


# ------------------------------------------------ tier C: learners, stream

SENTIMENT_MIN_DOCS = 20


def derived_lexicon(spark, sf_dir) -> DataFrame:
    """Terms (words and two-word phrases) scored -5..5 by the mean quality
    label of the labelled documents that contain them (at least
    ``SENTIMENT_MIN_DOCS`` documents): floor(10 * mean) - 5."""
    docs = _docs(spark, sf_dir, "doc_id", "text")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = docs.join(labels, "doc_id")
    # one row per (document, term): terms are de-duplicated inside each
    # document before the explode, so no shuffle is needed for it; the tokens
    # are a column first, so that a text is split once
    tokens = labelled.select("quality", java_tokens("text").alias("tokens"))
    pairs = tokens.select("quality", F.explode(F.array_distinct(text.terms_with_bigrams(F.col("tokens")))).alias("term"))
    per_term = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"))
    return per_term.where(F.col("n") >= SENTIMENT_MIN_DOCS).select(
        "term", (F.floor(F.lit(10.0) * F.col("q") / F.col("n")) - 5).cast("long").alias("score")
    )


def q_sentiment_by_source(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "source", "text")
    return text.lexicon_totals(docs, derived_lexicon(spark, sf_dir), "source")


RIDGE_REG = 0.5


def q_ridge_one_feature(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = models.linear("l_extendedprice", "features", reg=RIDGE_REG, solver="normal").fit(
        features.assemble(li, ["l_quantity"])
    )
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))], "slope double, intercept double"
    )


def _customer_part_ratings(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy(
        F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")
    ).agg(F.sum("l_quantity").alias("rating"))


def q_als_top_items(spark, sf_dir):
    from kilowatt.operators import learners

    model = learners.als(_customer_part_ratings(spark, sf_dir), "user", "item", "rating", rank=8,
                         max_iter=5, implicit=True)
    return learners.top_items(model, 5)


#: Documents in a partition of the topic model's training set.
TOPIC_ROWS = 20_000


def q_topics(spark, sf_dir):
    from kilowatt.operators import learners

    docs = features.tokenize(_docs(spark, sf_dir, "doc_id", "text").where(F.col("text").isNotNull()), "text", "words")
    counts = learners.hashed_counts(docs, "words").select("doc_id", "counts")
    counts = by_key(counts, ["doc_id"], train_partitions(_t(spark, sf_dir, "documents"), TOPIC_ROWS)).persist()
    model = learners.lda(counts, "counts", k=5, max_iter=10)
    counts.unpersist()
    return learners.topics(model, docs, "words", 5)


def q_pic_clusters(spark, sf_dir):
    from kilowatt.operators import learners

    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    edges = li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy(
        _node("o_custkey", CUSTOMER).alias("src"), _node("l_suppkey", SUPPLIER).alias("dst")
    ).agg(F.sum("l_quantity").alias("w"))
    return learners.pic(edges, "src", "dst", "w", k=3, max_iter=10)


def q_isotonic_curve(spark, sf_dir):
    from kilowatt.operators import learners

    li = _t(spark, sf_dir, "lineitem")
    return learners.isotonic_curve(learners.isotonic(li, "l_extendedprice", "l_quantity"))


def q_forest_classifier_metrics(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), to_vector("embedding").alias("features")
    )
    train, test = splits.key_split(emb, "vec_id", 10, 7)
    model = models.forest_classifier("label", "features", num_trees=20, seed=42).fit(train)
    return metrics.classification_metrics(model.transform(test), "label")


def q_kmeans_text_vectors(spark, sf_dir):
    from kilowatt.sources.delimited import scan_number_rows

    path = scratch_path(spark, "vectors-text")
    emb = _t(spark, sf_dir, "embeddings")
    emb.select(F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " ").alias("v")) \
        .write.text(path)
    pts = scan_number_rows(spark, path).select(to_vector("values").alias("features"))
    return clustering.centers(models.kmeans(k=10, seed=1).fit(pts))


def q_stream_kmeans(spark, sf_dir):
    from kilowatt.streaming.kmeans import stream_kmeans

    emb = _t(spark, sf_dir, "embeddings")
    src = scratch_path(spark, "stream-src")
    emb.select("vec_id", "embedding").write.parquet(src)
    init = [list(r["center"]) for r in
            clustering.label_centers(emb, "embedding", "label").orderBy("cluster").collect()]
    return stream_kmeans(spark, src, "vec_id long, embedding array<float>", "embedding", init, decay=1.0)


def q_single_fit_metrics(spark, sf_dir):
    """One pipeline fit without CV, scored on the test window."""
    return fc.single_fit_report(spark, sf_dir)


def q_stream_sentiment_by_source(spark, sf_dir):
    from kilowatt.streaming.sentiment import stream_lexicon_totals

    docs = _docs(spark, sf_dir, "doc_id", "source", "text")
    src = scratch_path(spark, "stream-docs")
    docs.write.parquet(src)
    lex = derived_lexicon(spark, sf_dir)
    return stream_lexicon_totals(spark, src, "doc_id long, source string, text string", lex, "source",
                                 max_files_per_trigger=4)


# ------------------------------------------------- trained, with a closed form

def q_csv_inferred(spark, sf_dir):
    """CSV scanned without a schema: types are inferred from the data."""
    path = scratch_path(spark, "csv-inferred")
    csv_src.write_csv(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return csv_src.scan_csv(spark, path)


def q_filter_boolean(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"))
    return relational.filter_by(li, "returned")


def q_assemble_two_columns(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    vec = features.assemble(li, ["l_quantity", "l_discount"], "features")
    return features.explode_vector(vec, "features", ["l_orderkey", "l_linenumber"])


def q_random_split_summary(spark, sf_dir):
    """The 70/30 split as two parts: rows, rows in both, rows in none, and whether
    the shares are within one in fifty of 70/30."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    train, test = splits.random_split(li, [0.7, 0.3], SEED, ["l_orderkey", "l_linenumber"])
    sides = li.select("*", F.lit(0).alias("train"), F.lit(0).alias("test")).unionByName(
        train.select("*", F.lit(1).alias("train"), F.lit(0).alias("test"))).unionByName(
        test.select("*", F.lit(0).alias("train"), F.lit(1).alias("test")))
    per = sides.groupBy("l_orderkey", "l_linenumber").agg(
        (F.count(F.lit(1)) - F.sum("train") - F.sum("test")).alias("n"), F.sum("train").alias("a"), F.sum("test").alias("b"))
    both = F.least("a", "b")
    return per.agg(
        F.sum("n").alias("n_rows"), F.sum(both).alias("n_both"), F.sum(F.col("n") - F.col("a") - F.col("b") + both).alias("n_none"),
        (F.abs(F.sum("a") / F.sum("n") - 0.7) < 0.02).alias("shares_right"))


def q_user_daily_series(spark, sf_dir):
    """The per-user daily panel before training: lags and the as-of reading."""
    series = fc.load_series(spark, sf_dir, keys=["user_id"], unit="day", observed="view")
    return series.select("user_id", "hour_ts", "n_events", *[F.round(c, 6).alias(c) for c in ("load", "t_m24", "t_m48", "obs_value")])


def q_kmeans_two_groups(spark, sf_dir):
    """k-means on two groups far apart: the centers are the groups' means."""
    far = F.when(F.col("l_linestatus") == "F", 0.0).otherwise(10_000.0).alias("far")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", far, "l_quantity")
    vec = by_key(features.assemble(li, ["far", "l_quantity"]), ["l_orderkey", "l_linenumber"], train_partitions(li))
    found = clustering.centers(models.kmeans(k=2, seed=1).fit(vec))
    return found.groupBy("cluster").pivot("slot", [0, 1]).agg(F.first("value")).select(
        F.round("0", 4).alias("far"), F.round("1", 6).alias("quantity"))


def q_logistic_two_rates(spark, sf_dir):
    """Logistic regression on one 0/1 feature: the logits of the two rates."""
    li = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "N").cast("double").alias("label"), (F.col("l_quantity") > 25).cast("double").alias("x"))
    model = models.logistic("label", "features", max_iter=500, tol=1e-12, standardization=False).fit(features.assemble(li, ["x"]))
    return spark.createDataFrame([(round(float(model.intercept), 4), round(float(model.coefficients[0]), 4))], "intercept double, slope double")


def q_isotonic_by_quantity(spark, sf_dir):
    from kilowatt.operators import learners

    li = _t(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    model = learners.isotonic(li, "l_extendedprice", "l_quantity")
    every = li.select(F.col("l_quantity").cast("double").alias("features")).distinct()
    return model.transform(every).select(F.col("features").alias("quantity"), F.round("prediction", 4).alias("prediction"))


def q_gbt_two_rounds(spark, sf_dir):
    """Two boosting rounds of depth 1: the second tree is fitted to the first
    one's residuals and added with the learning rate."""
    li = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    vec = features.assemble(li, ["l_quantity"])
    model = models.gbt("l_extendedprice", "features", max_iter=2, max_depth=1, step_size=GBT_RATE, max_bins=64).fit(vec)
    every = features.assemble(li.select("l_quantity").distinct(), ["l_quantity"])
    return model.transform(every).select("l_quantity", F.round("prediction", 4).alias("prediction"))


GBT_RATE = 0.1


def q_fitted_indexer_stump(spark, sf_dir):
    """An indexer fitted beforehand as a stage of a pipeline: the tree splits its
    two categories, so a row's prediction is its category's mean."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", F.when(F.col("l_linestatus") == "F", 7.0).otherwise(3.0).alias("code"), "l_extendedprice")
    vec = features.assemble(li, ["code"])
    indexer = features.index_categories(vec, "features", "indexedFeatures", max_categories=4)
    model = models.pipeline([indexer, models.stump("forest", "l_extendedprice", "indexedFeatures")]).fit(vec)
    return model.transform(vec).select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


def q_cv_depth_grid(spark, sf_dir):
    """CV over a forest's depth: 0 is the training mean, 1 the best single split."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    data = splits.with_folds(features.assemble(li, ["l_quantity"], "features"), 3, key="l_orderkey")
    est = models.stump("forest", "l_extendedprice", "features")
    cv = tuning.cross_validate(est, tuning.grid({est.maxDepth: [0, 1]}), tuning.regression_evaluator("l_extendedprice", "rmse"), data, 3, "fold", 2)
    return tuning.cv_results(cv).select(
        F.get_json_object("params", "$.maxDepth").cast("int").alias("max_depth"), F.round("avg_metric", 3).alias("avg_rmse"))


def q_cv_selection_metrics(spark, sf_dir):
    """One search judged by each of the four metrics; the chosen setting is the
    best by that metric."""
    found = _cv_linear(spark, sf_dir, mae=True)
    rows = [(metric, s[0], float(f"{found.average(s, metric):.6g}"), s == found.best(metric)) for metric in ("rmse", "mse", "r2", "mae") for s in LINEAR_SETTINGS]
    return spark.createDataFrame(rows, "metric string, fit_intercept boolean, avg_metric double, chosen boolean")


# ----------------------------------------------------- boosted trees as tables

SMALL_TREE = boosting.Setting(max_depth=3, num_leaves=4, learning_rate=1.0, rounds=1)


def _small_tree(spark, sf_dir):
    """A leaf-wise tree of four leaves over two features, and the rows it is fitted to."""
    li = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    fits = boosting.fit_many(li, ["l_quantity", "l_discount"], "l_extendedprice", [SMALL_TREE], max_bins=64)
    start, nodes = fits.of(SMALL_TREE)
    return li, start, trees.node_table(spark, nodes)


def q_leaf_budget_small(spark, sf_dir):
    """Scored from the node table: the mean label, then the tree's values."""
    li, start, nodes = _small_tree(spark, sf_dir)
    every = li.select("l_quantity", "l_discount").distinct()
    scored = trees.score(every, nodes, ["l_quantity", "l_discount"], start)
    return scored.select("l_quantity", "l_discount", F.round("prediction", 4).alias("prediction"))


def q_tree_nodes(spark, sf_dir):
    _, start, nodes = _small_tree(spark, sf_dir)
    return nodes.select("node", "slot", F.round("threshold", 6).alias("threshold"), "n", F.round(F.col("value") + start, 4).alias("value"))


def q_forest_rescored(spark, sf_dir):
    """A fitted model's trees as a table, and every row scored from that."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = models.stump("forest", "l_extendedprice", "features", max_bins=64).fit(features.assemble(li, ["l_quantity"], "features"))
    scored = trees.score(li, trees.model_nodes(model), ["l_quantity"], weights=trees.model_weights(model))
    return scored.select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


def q_gbt_rescored(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    vec = features.assemble(li, ["l_quantity"])
    model = models.gbt("l_extendedprice", "features", max_iter=2, max_depth=1, step_size=GBT_RATE, max_bins=64).fit(vec)
    scored = trees.score(li.select("l_quantity").distinct(), trees.model_nodes(model), ["l_quantity"], weights=trees.model_weights(model))
    return scored.select("l_quantity", F.round("prediction", 4).alias("prediction"))


BOOSTED_CV = (boosting.Setting(1, 2, 1.0, 1), boosting.Setting(1, 2, 0.5, 1))


def q_boosted_cv_small(spark, sf_dir):
    """Two settings and three folds of boosting in one pass."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    data = splits.with_folds(li, 3, key="l_orderkey")
    fits = boosting.fit_many(data, ["l_quantity"], "l_extendedprice", BOOSTED_CV, 3, "fold", max_bins=64)
    found = [(s.learning_rate, m["rmse"], m["mae"]) for s, _, m in fits.metrics()]
    rows = spark.createDataFrame(found, "learning_rate double, rmse double, mae double")
    return rows.groupBy("learning_rate").agg(F.round(F.avg("rmse"), 3).alias("avg_rmse"), F.round(F.avg("mae"), 3).alias("avg_mae"))


def q_indexed_gbt_small(spark, sf_dir):
    """A category indexer's slot in a boosted tree: the best division of three
    categories, which no threshold of their codes gives."""
    code = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0)
    label = F.when(F.col("l_returnflag") == "N", F.col("l_quantity") + 100).otherwise(F.col("l_quantity"))
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", code.alias("code"), label.alias("label"))
    setting = boosting.Setting(1, None, 0.1, 2, 1, "tree")
    fits = boosting.fit_many(li, ["code"], "label", [setting], max_categories=4)
    start, nodes = fits.of(setting)
    scored = trees.score(li.select("l_returnflag", "code").distinct(), trees.node_table(spark, nodes), ["code"], start)
    return scored.select("l_returnflag", F.round("prediction", 4).alias("prediction"))


# ------------------------------------- ranking, clusters, topics, regular series

RANKING_K = 5
#: Rows of lineitem in a partition.
RANKING_ROWS = 250_000


def q_ranking_metrics(spark, sf_dir):
    """Parts a customer bought, by quantity, against those sent back."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_quantity", "l_returnflag")
    # a partition has so many rows, however well the shuffled rows compress
    parts = train_partitions(li, RANKING_ROWS)
    bought = li.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), li.l_orderkey == orders.o_orderkey)
    scored = bought.repartition(parts, "user", "item").groupBy("user", "item").agg(F.sum("l_quantity").alias("score"))
    out = ranking.ranking_metrics(scored, bought.where("l_returnflag = 'R'"), "user", "item", "score", RANKING_K, parts)
    return out.select("n_users", *[F.round(c, 8).alias(c) for c in ("precision_at_k", "map_at_k", "ndcg_at_k")])


LLOYD_ROUNDS = 3


def q_lloyd_three_rounds(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select("embedding", "label")
    found = clustering.lloyd(emb, "embedding", clustering.label_centers(emb, "embedding", "label"), LLOYD_ROUNDS, -1.0)
    return found.select("cluster", F.posexplode("center").alias("slot", "value")).select("cluster", "slot", F.round("value", 6).alias("value"))


def q_lloyd_text_vectors(spark, sf_dir):
    """Vectors written as rows of numbers, scanned back, and one round from the labels' centers."""
    from kilowatt.sources.delimited import scan_number_rows

    path = scratch_path(spark, "vectors-text")
    emb = _t(spark, sf_dir, "embeddings").select("embedding", "label")
    emb.select(F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " ").alias("v")).write.text(path)
    found = clustering.lloyd(scan_number_rows(spark, path), "values", clustering.label_centers(emb, "embedding", "label"), 1)
    return found.select("cluster", F.posexplode("center").alias("slot", "value")).select("cluster", "slot", F.round("value", 6).alias("value"))


COHERENCE_TERMS = 5


def q_topic_coherence(spark, sf_dir):
    """Each language's most frequent tokens as its topic."""
    from kilowatt.operators import learners

    docs = features.tokenize(_docs(spark, sf_dir, "doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL"), "text", "words")
    counts = docs.select("lang", F.explode("words").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "term"))
    terms = counts.withColumn("rank", rank).where(F.col("rank") <= COHERENCE_TERMS).select(F.col("lang").alias("topic"), "rank", "term")
    return learners.coherence(docs, "doc_id", "words", terms).select("topic", "n_terms", F.round("coherence", 6).alias("coherence"))


def q_regular_series(spark, sf_dir):
    """Each user's load for every day between the first and the last event."""
    ev = _t(spark, sf_dir, "events").select("user_id", "ts", "value")
    days = hourly(ev, "ts", "value", keys=["user_id"], unit="day")
    out = regular(days, "hour_ts", "load", ["user_id"], unit="day", counts=["n_events"])
    return out.select("user_id", "hour_ts", F.round("load", 6).alias("load"), "n_events")


def q_stream_kmeans_scored(spark, sf_dir):
    """A stream scored with the centers that another stream has learned in one batch."""
    from kilowatt.streaming.kmeans import score_stream, stream_kmeans

    emb = _t(spark, sf_dir, "embeddings")
    src, work = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-model")
    emb.select("vec_id", "label", "embedding").write.parquet(src)
    init = [list(r["center"]) for r in clustering.label_centers(emb, "embedding", "label").orderBy("cluster").collect()]
    schema = "vec_id long, label int, embedding array<float>"
    stream_kmeans(spark, src, schema, "embedding", init, decay=1.0, max_files_per_trigger=1_000_000, work_dir=work)
    scored = score_stream(spark, src, schema, "embedding", work, max_files_per_trigger=4)
    return scored.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


def q_csv_text_lines(spark, sf_dir):
    """Texts with line breaks, quotes and commas written as CSV and scanned back."""
    path = scratch_path(spark, "csv-text")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    csv_src.write_csv(docs, path)
    back = csv_src.scan_csv(spark, path, schema=docs.schema, multiline=True)
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "lang")


def q_baskets_roundtrip(spark, sf_dir):
    """Orders as lines of part numbers, scanned as baskets: how many baskets hold each part."""
    from kilowatt.sources.delimited import scan_baskets

    path = scratch_path(spark, "baskets")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), " ").alias("v")).select("v").write.text(path)
    items = scan_baskets(spark, path).select(F.explode(F.col("items").cast("array<bigint>")).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n_baskets"))


def q_labeled_rows_roundtrip(spark, sf_dir):
    """``label,f1 f2`` lines scanned back: rows and sums of each label."""
    from kilowatt.sources.delimited import scan_labeled_rows

    path = scratch_path(spark, "labeled")
    li = _t(spark, sf_dir, "lineitem")
    li.select(F.concat(F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_quantity").cast("string"), F.lit(" "), F.col("l_discount").cast("string")).alias("v")).write.text(path)
    rows = scan_labeled_rows(spark, path)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("values")[0]), 4).alias("quantity"), F.round(F.sum(F.col("values")[1]), 4).alias("discount"))


def _boosted_metrics(kind):
    def q(spark, sf_dir):
        return fc.boosted_report(fc.boosted_forecast(spark, sf_dir, kind), kind)

    return q


#: Queries with the reference's full grids of trees.
SLOW = ("forest_depth_grid_metrics", "leaf_budget_forecast_metrics", "indexed_gbt_forecast_metrics", "gbt_forecast_metrics")


def queries() -> dict[str, Query]:
    return {
        "csv_roundtrip": q_csv_roundtrip,
        "csv_inferred": q_csv_inferred,
        "filter_boolean": q_filter_boolean,
        "assemble_two_columns": q_assemble_two_columns,
        "random_split_summary": q_random_split_summary,
        "user_daily_series": q_user_daily_series,
        "kmeans_two_groups": q_kmeans_two_groups,
        "logistic_two_rates": q_logistic_two_rates,
        "isotonic_by_quantity": q_isotonic_by_quantity,
        "gbt_two_rounds": q_gbt_two_rounds,
        "fitted_indexer_stump": q_fitted_indexer_stump,
        "cv_depth_grid": q_cv_depth_grid,
        "cv_selection_metrics": q_cv_selection_metrics,
        "libsvm_roundtrip": q_libsvm_roundtrip,
        "word_count": q_word_count,
        "word_count_saved": q_word_count_saved,
        "files_partitioned": q_files_partitioned,
        "project_view": q_project_view,
        "filter_before": q_filter_before,
        "filter_half_open": q_filter_half_open,
        "filter_after": q_filter_after,
        "split_time": q_split_time,
        "split_key": q_split_key,
        "split_random": q_split_random,
        "hourly_load": q_hourly_load,
        "calendar_features": q_calendar_features,
        "lag_24_48": q_lag_24_48,
        "asof_last_view": q_asof_last_view,
        "assemble_slots": q_assemble_slots,
        "index_categories": q_index_categories,
        "persistence_metrics": q_persistence_metrics,
        "forest_stump": _stump_query("forest"),
        "gbt_stump": _stump_query("gbt"),
        "leaf_budget_stump": _stump_query("leaf_budget"),
        "cv_results": q_cv_results,
        "cv_closed_form": q_cv_closed_form,
        "assign_given_centers": q_assign_given_centers,
        "silhouette_given_labels": q_silhouette_given_labels,
        "classification_metrics": q_classification_metrics,
        "auc_given_score": q_auc_given_score,
        "tokenize_counts": q_tokenize_counts,
        "hash_tf_totals": q_hash_tf_totals,
        "pagerank_5": q_pagerank_5,
        "frequent_itemsets": q_frequent_itemsets,
        "association_rules": q_association_rules,
        "forest_forecast_metrics": _forecast_metrics("forest"),
        "forest_random_split_metrics": _forecast_metrics("forest", "forest_random_split", split="random"),
        "forecast_predictions": q_forecast_predictions,
        "gbt_forecast_metrics": _forecast_metrics("gbt"),
        "leaf_budget_forecast_metrics": _boosted_metrics("leaf_budget"),
        "indexed_gbt_forecast_metrics": _boosted_metrics("indexed_gbt"),
        "ranking_metrics": q_ranking_metrics,
        "lloyd_three_rounds": q_lloyd_three_rounds,
        "lloyd_text_vectors": q_lloyd_text_vectors,
        "topic_coherence": q_topic_coherence,
        "regular_series": q_regular_series,
        "stream_kmeans_scored": q_stream_kmeans_scored,
        "csv_text_lines": q_csv_text_lines,
        "baskets_roundtrip": q_baskets_roundtrip,
        "labeled_rows_roundtrip": q_labeled_rows_roundtrip,
        "leaf_budget_small": q_leaf_budget_small,
        "tree_nodes": q_tree_nodes,
        "forest_rescored": q_forest_rescored,
        "gbt_rescored": q_gbt_rescored,
        "boosted_cv_small": q_boosted_cv_small,
        "indexed_gbt_small": q_indexed_gbt_small,
        "forest_depth_grid_metrics": _forecast_metrics("forest", "forest_depth_grid", axes_override={"maxDepth": [6, 8, 10, 15]}),
        "best_params": q_best_params,
        "tree_dump": q_tree_dump,
        "kmeans_centers": q_kmeans_centers,
        "kmeans_silhouette": q_kmeans_silhouette,
        "text_quality_auc": q_text_quality_auc,
        "sentiment_by_source": q_sentiment_by_source,
        "ridge_one_feature": q_ridge_one_feature,
        "als_top_items": q_als_top_items,
        "topics": q_topics,
        "pic_clusters": q_pic_clusters,
        "isotonic_curve": q_isotonic_curve,
        "forest_classifier_metrics": q_forest_classifier_metrics,
        "kmeans_text_vectors": q_kmeans_text_vectors,
        "stream_kmeans": q_stream_kmeans,
        "panel_forecast_metrics": _forecast_metrics("forest", "forest_panel_event_type", keys=["event_type"]),
        # per user and day: lags of the two previous days and the latest 'view' reading
        # at or before each day (as-of join)
        "user_daily_forecast_metrics": _forecast_metrics("forest", "forest_user_daily", keys=["user_id"], unit="day", observed="view"),
        "text_scan_word_count": q_text_scan_word_count,
        "delimited_roundtrip": q_delimited_roundtrip,
        "preview_lineitem": q_preview_lineitem,
        "schema_table": q_schema_table,
        "single_fit_metrics": q_single_fit_metrics,
        "stream_sentiment_by_source": q_stream_sentiment_by_source,
    }
