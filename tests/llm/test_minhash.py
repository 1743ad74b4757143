"""ProbMinHash near-duplicates against all pairs, and the edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kilowatt.llm import minhash


def _sets(texts):
    doc, element, weight = minhash.shingles(pa.array(texts, pa.large_string()))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(element[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _plain(a, b):
    """The probability Jaccard by its definition."""
    a, b = dict(zip(*a)), dict(zip(*b))
    total = 0.0
    for d in set(a) & set(b):
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b))
    return total


def _corpus(seed=1):
    """Texts with copies, near copies of several strengths, chains and short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 220))) for _ in range(60)]
    for base in list(texts[:30]):
        words = base.split()
        for edits in (1, 1, 2, 4):
            w = list(words)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
            words = w if rnd.random() < 0.5 else words
    texts += texts[:15] + [texts[0].upper(), "", "", " ", "one two", "one two", "ONE two", "x " * 300, "x " * 500]
    rnd.shuffle(texts)
    return texts


def _groups(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = _sets(texts)
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (len(sets[i][0]) and minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD - minhash.ROUNDING):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similarity_is_its_definition():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ({rnd.randrange(12): float(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 9))} for _ in range(2))
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert minhash.similarity(*pair) == pytest.approx(_plain(*pair))


def test_equal_weights_give_jaccard():
    a, b = _sets(["a b c d e f g h i j", "a b c d e f g h x y"])
    both, every = len(set(a[0]) & set(b[0])), len(set(a[0]) | set(b[0]))
    assert minhash.similarity(a, b) == pytest.approx(both / every)


def test_matrix_of_links_is_that_of_single_pairs():
    texts = _corpus(seed=7)
    texts += [texts[0] + " " + texts[0], texts[1] + " " + texts[1] + " " + texts[1][:40], "la " * 50 + "end of it", "la " * 60 + "end of it"]
    sets = _sets(texts)
    mark = np.arange(len(texts)) % 2
    for other in (None, mark):
        near = minhash.linked(pa.array(texts, pa.large_string()), other)
        for i in range(len(texts)):
            for j in range(i):
                want = minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD - minhash.ROUNDING and (other is None or mark[i] != mark[j])
                assert near[i, j] == near[j, i] == want


def test_registers_agree_with_the_similarity():
    words = [f"w{i}" for i in range(200)]
    other = words[:60] + ["x"] + words[61:150] + ["y"] + words[151:] + words[:30]
    texts = pa.array([" ".join(words), " ".join(other)], pa.large_string())
    doc, element, weight = minhash.shingles(texts)
    rows = minhash.signatures(doc, element, weight, 2, 8192)
    assert (rows[0] == rows[1]).mean() == pytest.approx(minhash.similarity(*_sets(texts.to_pylist())), abs=0.02)


def test_every_register_is_filled_for_a_short_text():
    rows = minhash.signatures(*minhash.shingles(pa.array(["one two"], pa.large_string())), 1, 64)
    assert len(set(rows[0].tolist())) == 1 and rows[0, 0] != 0


@pytest.mark.parametrize("leaders, block", [(True, 512), (False, 512), (True, 3)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, leaders, block):
    """With and without the comparison with leaders, and with blocks smaller than the buckets."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)
    texts = _corpus()
    ids = list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "c", "b") for i, t in zip(ids, texts)], "doc_id long, text string, content string, bands string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, leaders=leaders).collect()}
    want = _groups(texts)
    assert {i: got[i]["group_id"] for i in ids} == dict(enumerate(want))
    assert all(got[i]["class_id"] == texts.index(texts[i]) for i in ids)
    assert all(got[i]["kept"] == (want[i] == i) for i in ids)
    kept = sorted(r["doc_id"] for r in minhash.drop_near_duplicates(df).collect())
    assert kept == sorted(set(want))


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (None, text), (2, None), (None, None), (None, "alone and without a name"), (None, "alone and without a name"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    of = {(r["doc_id"], r["class_id"], r["group_id"], r["kept"]) for r in got}
    assert of == {(1, 1, 1, True), (None, 1, 1, False), (2, 2, 2, True), (None, None, None, True), (None, None, None, False), (5, 5, 5, True)}
    left = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in minhash.drop_near_duplicates(df).collect()))
    assert left == sorted([(False, 1, text), (False, 2, ""), (True, 0, ""), (True, 0, "alone and without a name"), (False, 5, "")])
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(df.limit(0)).columns == df.columns
