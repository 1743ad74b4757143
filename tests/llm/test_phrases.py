"""Phrase collocations against plain counts of every run of words."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kilowatt.llm import oracle, phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, score string"


def _brute(rows, top, least=30):
    f = defaultdict(Counter)
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for m in range(1, 5):
                f[lang if lang is not None else "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                covered |= {p[i:i + m] for i in range(len(p) - m + 1) if 100 * a >= 80 * counts[p[i:i + m]]}
        kept = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def _texts(seed, n=160):
    """Few words, so that many runs repeat; set phrases, loops of one word, signs, nulls, empty texts."""
    rng = np.random.default_rng(seed)
    words = ["The", "a", "of", "é", "ñu", "x-y", "TEA", "Cup", "zz", "no", "es", "en", "\xa0q", "w\x1c"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 60))):
            kind = rng.random()
            parts.append("cup of black tea" if kind < 0.05 else "no no no no no" if kind < 0.08 else str(rng.choice(words, p=share / share.sum())))
            parts.append(str(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "!"], p=[0.8, 0.05, 0.05, 0.03, 0.03, 0.02, 0.02])))
        rows.append(("".join(parts), [None, "en", "es", ""][k % 4], "x"))
    return [*rows, (None, "en", None), ("", "en", None), (" .. ", "zz", None), rows[1], rows[1]]


@pytest.mark.parametrize("top,opened", [(2000, 4000), (12, 5), (12, 1)])
def test_phrases_are_those_of_plain_counts(spark, top, opened):
    """Also with a frontier that is opened in several rounds; a foreign column ``score``."""
    rows = _texts(top)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrases.collocations(df, top=top, opened=opened)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, top)


def test_large_counts_are_exact(spark):
    row = spark.createDataFrame([(10**14 + 7, 2 * 10**14 + 1, 10**14 + 9)], "a long, l long, r long")
    got = row.select(phrases.score("a", "l", "r").alias("s")).first()["s"]
    assert got == 2_000_000 * (10**14 + 7) // (3 * 10**14 + 10)


@pytest.mark.parametrize("size", [16, 64, 1 << 20])
def test_slices_of_a_long_text_give_all_runs(size):
    rng = np.random.default_rng(size)
    text = "".join(str(rng.choice(["ab", "c" * 90, "d", "é", " ", "  ", ".", "\t"])) for _ in range(3000)) + "tail"
    counts = Counter()
    for _, raw, offsets, seen in phrases.slices(pa.array([text, "ab d"]), size):
        part = phrases.Text(raw, offsets, np.zeros(len(offsets) - 1, np.uint64), seen, 0)
        for m in range(1, 5):
            at = part.runs(m)
            counts.update(zip(*[part.word[at + k].tolist() for k in range(m)], strict=True))
    want = Counter()
    for one in (text, "ab d"):
        for piece in re.split(r"[.]", one):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for m in range(1, 5):
                want.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    assert sorted(counts.values()) == sorted(want.values())


def test_words_of_one_number_take_another_seed(spark, monkeypatch):
    calls, count = [], phrases.count_words

    def twice(texts, seed=0):
        calls.append(seed)
        words = count(texts, seed)
        return words.withColumn("word", words["word"] * 0) if seed == 0 else words

    monkeypatch.setattr(phrases, "count_words", twice)
    rows = [("a b a b", "en", None)] * 40
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert calls == [0, 1] and sorted(tuple(r) for r in got) == _brute(rows, 2000)


def test_words_that_differ_are_told_apart():
    texts = pa.array(["ab ac ab", "ab"]).cast(pa.large_string())
    part = phrases.Text(*phrases.flat.utf8(texts), np.array([1, 2], np.uint64), 0, 0)
    assert list(part.unlike(np.array([0, 0, 0, 3]), np.array([2, 1, 3, 3]))) == [1, 2]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b", "en", None)], SCHEMA)).collect() == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(oracle.PHRASES).df()
    got = queries.op12_phrases(spark, "/root/testdata/sf0.01").toPandas()[list(want.columns)]
    key = ["lang", "rank"]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
