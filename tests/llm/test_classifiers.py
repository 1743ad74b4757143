"""Language id, toxicity and quality: methods by brute force, held-out accuracy, edge cases."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilowatt.llm import langid, linear, quality, queries, toxicity

MID = "/root/testdata/sf0.01"


def _brute_grams(text):
    import unicodedata

    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
            continue
        if word:
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i:i + n]
                    if g.strip() and (n < 3 or g[1] != " "):
                        out[g] += 1
        word = ""
    return out


def _name(gram):
    return "".join(chr(x) for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


def test_grams_are_those_of_a_plain_count():
    texts = ["Hello, wörld! a b", "", "123 --", "aaa", "日本 x", "don't", "\n\nend"]
    owner, gram, count = langid.grams(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert {_name(g): n for o, g, n in zip(owner, gram, count) if o == i} == dict(_brute_grams(text))


def test_profile_ranks_and_distance():
    train = {"aa": "the the then that this", "bb": "der die das und der der"}
    rows, ranks = [], {}
    for lang, text in train.items():
        ordered = sorted(_brute_grams(text).items(), key=lambda kv: (-kv[1], [ord(c) for c in kv[0]] + [0] * (3 - len(kv[0]))))
        ranks[lang] = {g: k for k, (g, _) in enumerate(ordered[:langid.TOP])}
        o, g, r = langid.profiles(*langid.grams(pa.array([text], pa.large_string())))
        assert {_name(x): k for x, k in zip(g, r)} == ranks[lang]
        rows += [(lang, int(x), int(k)) for x, k in zip(g, r)]
    known = langid.Profiles(rows)
    for text in ("then the", "und die", "xyz"):
        own = {_name(x): k for x, k in zip(*langid.profiles(*langid.grams(pa.array([text], pa.large_string())))[1:])}
        far = {lang: sum(abs(k - ranks[lang][g]) if g in ranks[lang] else langid.TOP for g, k in own.items()) for lang in train}
        names, score = known.nearest(pa.array([text], pa.large_string()))
        assert names[0] == min(sorted(far), key=far.get)
        assert score[0] == pytest.approx(1 - min(far.values()) / (langid.TOP * len(own)))


def test_language_query_on_held_out_rows(spark):
    got = queries.op1_language_id(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (None, "the", "en"), (3, None, "en"), (4, "42 !!", None), (4, "42 !!", None), (5, "der " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit("i"))
    got = langid.identify(df, langid.fit(df)).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == 7 and {(1, "en"), (2, "de"), (None, "en"), (3, "und"), (4, "und"), (5, "de")} == by
    none = df.limit(0)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(none)).collect()} == {"und"}


def test_ftrl_is_the_plain_update():
    """One row at a time against the update written out for single numbers."""
    rng = np.random.default_rng(0)
    model = linear.Ftrl(6, alpha=0.5, beta=1.0, l1=0.2, l2=0.3)
    z, n = np.zeros(7), np.zeros(7)

    def weight(i):
        l1 = 0 if i == 6 else 0.2
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / 0.5 + 0.3)

    for _ in range(60):
        at = np.flatnonzero(rng.random(6) < 0.5)
        label = float(rng.random() < 0.5)
        used = [*at, 6]
        w = {i: weight(i) for i in used}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in used:
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.5
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.update(np.zeros(len(at), np.int64), at, np.ones(len(at)), np.array([label]))
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op6_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 0].predicted.mean() < 0.005 and held[held.toxic == 1].predicted.mean() > 0.8


def test_toxicity_edges(spark):
    rows = [(i, f"you are awful {i}" if i % 2 else f"good day {i}") for i in range(60)] + [(None, "awful"), (99, None), (99, None), (100, ""), (101, "awful " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(3)).withColumn("id", F.lit("a")).withColumn("toxicity", F.lit("b"))
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(60)], (3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    clash = labels.withColumn("id", F.lit("z")).withColumn("label", F.lit("z"))
    assert toxicity.fit(docs, clash, where=F.col("id") < 0) is None and toxicity.fit(docs, clash, where=F.col("id") >= 0) is not None
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in got)
    by = {r["doc_id"]: r["toxicity"] for r in got}
    assert by[99] == by[100] and by[7] > by[8]
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None
    assert {r["toxicity"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_posteriors_find_the_hidden_class():
    """EM recovers class and labeller accuracy of votes drawn from a known model."""
    rng = np.random.default_rng(4)
    n, k = 40_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.95, k)
    vote = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None])
    votes = np.where(rng.random((n, k)) < 0.3, quality.NONE, np.where(vote, quality.GOOD, quality.BAD))
    pattern, place, count = np.unique(quality._patterns(votes), return_inverse=True, return_counts=True)
    found = quality.posteriors(pattern, count.astype(float))[place]
    assert ((found > 0.5) == good).mean() > 0.97
    assert abs(found.mean() - good.mean()) < 0.02


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op8_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.995
    assert got[got.quality == 0].kept.mean() < 0.03


def test_quality_edges(spark):
    rows = [(i, "A plain sentence stands here. It has some words.") for i in range(40)] + [(100 + i, "BUY!! NOW!! $$$ %%% ###") for i in range(8)]
    rows += [(None, "A plain sentence stands here."), (7, None), (8, ""), (8, ""), (9, " \n "), (10, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality_score", F.lit("x")).withColumn("__quality", F.lit("y")).withColumn("good", F.lit(0))
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert all(r["__quality"] == "y" for r in got)
    assert all((r["quality_score"] == 0) == (not (r["text"] or "").strip()) for r in got)
    empty = quality.fit(docs.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0
    assert {r["quality_score"] for r in quality.score(docs.where("text = ''"), empty).collect()} == {0.0}
