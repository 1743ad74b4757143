"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote on every document (good, bad, or no vote) from
statistics of its whole text. Expectation-maximisation over the counts of
all vote patterns estimates how often each labeller gives each vote to good
and to bad documents, and with that the posterior of every pattern. The
posteriors, not any given label, train a linear scorer over hashed word
shapes, whose score is the result.

Counts of patterns cover all documents; their number is bounded by the number
of possible patterns. The scorer is fitted in one task on a bounded sample
(``FIT_ROWS`` rows, by the hash of their id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilowatt.llm import flat
from kilowatt.llm.linear import Ftrl, sigmoid
from kilowatt.llm.shared import checkpointed

#: At most so many rows are used to fit the scorer.
FIT_ROWS = 12_000
BITS = 18
EPOCHS = 3
#: A document is kept from this score on; short texts of few shapes score lower than long ones.
KEEP = 0.4
#: A labeller's votes.
BAD, NONE, GOOD = 0, 1, 2

_LETTER, _UPPER, _DIGIT, _PLAIN, _ODD = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or (_c.isalpha() and _c.islower()):
        _KIND[_b] = _LETTER
    elif _c.isalpha():
        _KIND[_b] = _LETTER | _UPPER
    elif _c.isdigit():
        _KIND[_b] = _DIGIT
    elif _c in ".,;:?!'\"()-":
        _KIND[_b] = _PLAIN
    elif _b > 32:
        _KIND[_b] = _ODD

#: Labellers: name, lower and upper bound of a good document's statistic, and
#: the bounds outside which a document is bad; between them there is no vote.
LABELLERS = (
    ("odd signs among visible bytes", (None, 0.02), (None, 0.08)),
    ("capitals among letters, of 10 letters or more", (None, 0.15), (None, 0.4)),
    ("digits among visible bytes", (None, 0.1), (None, 0.6)),
    ("plain signs among visible bytes", (None, 0.06), (None, 0.3)),
    ("words that hold a letter", (0.95, None), (0.7, None)),
    ("words that are letters, then at most one plain sign, of 20 words or more", (0.92, None), (0.6, None)),
    ("letters in a word", (2.0, 9.0), (0.8, 20.0)),
    ("words that repeat the word before, of 10 words or more", (None, 0.05), (None, 0.2)),
    ("different words among words, of 40 words or more", (0.35, None), (0.15, None)),
    ("different lines among lines, of 5 lines or more", (0.7, None), (0.3, None)),
)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(a row of the labellers' statistics for each text, number of words, the
    words); a statistic that a text is too short for is NaN."""
    raw, offsets = flat.utf8(texts)
    n = len(texts)
    starts, ends, doc = flat.word_spans(raw, offsets)
    kind = _KIND[raw]

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def in_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[ends] - sums[starts]

    is_letter = (kind & _LETTER) > 0
    words = np.bincount(doc, minlength=n).astype(float)
    seen, letters = total(raw > 32), total(is_letter)
    letters_of = in_word(is_letter)
    plain_end = (kind[ends - 1] == _PLAIN) if len(ends) else np.zeros(0, bool)
    clean = (letters_of == ends - starts) | (plain_end & (letters_of == ends - starts - 1) & (letters_of > 0))

    def share(a: np.ndarray, b: np.ndarray, least: float = 1) -> np.ndarray:
        return np.where(b >= least, a / np.maximum(b, 1), np.nan)

    hashes = flat.span_hashes(raw, starts, ends)
    line_starts, line_ends, line_doc = flat.spans(raw != 10, offsets)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    out = np.stack([
        share(total(kind == _ODD), seen), share(total((kind & _UPPER) > 0), letters, 10), share(total(kind == _DIGIT), seen),
        share(total(kind == _PLAIN), seen), share(np.bincount(doc, letters_of > 0, n), words), share(np.bincount(doc, clean, n), words, 20),
        share(letters, words), share(np.bincount(doc[1:], _repeats(doc, hashes)[1:], n), words, 10),
        share(_different(doc, hashes, n), words, 40),
        share(_different(line_doc, flat.span_hashes(raw, line_starts, line_ends), n), lines, 5),
    ], axis=1)
    return out, words, (raw, starts, ends, doc)


def _different(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    key = np.unique(flat.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(doc[key], minlength=n).astype(float)


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a word is the same as the word before it in its text."""
    out = np.zeros(len(doc), bool)
    out[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    return out


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of the labellers (BAD, NONE, GOOD), a row for each text."""
    out = np.full(stats.shape, NONE, np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        x = stats[:, k]
        low, high = (-np.inf if v is None else v for v in (good[0], bad[0])), (np.inf if v is None else v for v in (good[1], bad[1]))
        (good_low, bad_low), (good_high, bad_high) = low, high
        out[(x >= good_low) & (x <= good_high), k] = GOOD
        out[(x < bad_low) | (x > bad_high), k] = BAD
    return out


def _patterns(votes_: np.ndarray) -> np.ndarray:
    return (votes_ * 3 ** np.arange(votes_.shape[1])).sum(1)


def posteriors(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability that a document of each pattern is good.

    Expectation-maximisation of a two-class model in which the labellers vote
    independently given the class; where one has no vote, it says nothing. It begins from the
    belief that one bad vote marks a bad document; counts are smoothed by one vote of each kind. A pattern
    without any vote gets the share of good documents.
    """
    votes_ = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    cast = (votes_ != NONE).sum(1)
    good = np.where(cast == 0, 0.5, np.where((votes_ == BAD).any(1), 0.1, 0.9))
    for _ in range(rounds):
        prior = ((good * count).sum() + 1) / (count.sum() + 2)
        log = np.tile(np.log([1 - prior, prior]), (len(pattern), 1))
        for k in range(len(LABELLERS)):
            for label, weight in enumerate(((1 - good) * count, good * count)):
                table = np.bincount(votes_[:, k], weight, 3)[[BAD, GOOD]] + 1
                table = np.log(table / table.sum())
                log[:, label] += np.where(votes_[:, k] == NONE, 0.0, np.where(votes_[:, k] == GOOD, table[1], table[0]))
        new = sigmoid(log[:, 1] - log[:, 0])
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good


def features(words: tuple, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, coordinate, value): shapes of words and of pairs of words.

    A shape is the word's run of kinds (capital, letter, digit, or the sign
    itself), repeats joined; a word that repeats the word before has a shape of
    its own. The values of a text are its shapes' counts over
    the root of the sum of their squares.
    """
    raw, starts, ends, doc = words
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = np.where(_KIND[raw] & _UPPER, 65, np.where(_KIND[raw] & _LETTER, 97, np.where(_KIND[raw] & _DIGIT, 48, raw))).astype(np.uint8)
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    before = np.concatenate([[0], np.cumsum(new)])
    shape = flat.span_hashes(kind[new], before[starts], before[ends])
    shape[_repeats(doc, flat.span_hashes(raw, starts, ends))] = 0
    same = doc[1:] == doc[:-1]
    pair = flat.mix(shape[:-1][same] * np.uint64(0xA24BAED4963EE407) + shape[1:][same])
    doc = np.concatenate([doc, doc[1:][same]])
    key = doc << BITS | (np.concatenate([shape, pair]) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc, value = key >> BITS, count.astype(float)
    value /= np.sqrt(np.bincount(doc, value * value, minlength=texts))[doc]
    return doc, key & ((1 << BITS) - 1), value


class Model:
    """Posterior of every vote pattern, and the scorer's weights."""

    def __init__(self, pattern: np.ndarray, good: np.ndarray, at: np.ndarray, weight: np.ndarray, bias: float):
        self.pattern, self.good, self.at, self.weight, self.bias = pattern, good, at, weight, bias

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        if not len(self.pattern):
            return np.full(len(pattern), 0.5)
        at = np.minimum(np.searchsorted(self.pattern, pattern), len(self.pattern) - 1)
        return np.where(self.pattern[at] == pattern, self.good[at], 0.5)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """The weak-label model of all documents and the scorer fitted on its posteriors.

    Null texts and texts without a word cast no vote and are left out. No
    documents: an empty model. The pattern table has at most 3**labellers
    rows, the weights at most 2**BITS.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                stats, words, _ = statistics(texts)
                keep = pa.array(words > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)).filter(keep), pa.array(_patterns(votes(stats))).filter(keep)], names=["id", "pattern"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    seen = checkpointed(own.mapInArrow(look, f"id {kind}, pattern long"))
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    pattern = np.array([r["pattern"] for r in counted], np.int64)
    if not len(pattern):
        return Model(pattern, np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    good = posteriors(pattern, np.array([r["n"] for r in counted], float))
    model = Model(pattern, good, np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    picked = seen.where("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                n = len(texts)
                stats, words, spans = statistics(texts)
                doc, at, value = features(spans, n)
                ends = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(model.posterior(_patterns(votes(stats)))),
                     flat.binary_column(at.astype("<i4"), ends), flat.binary_column(value.astype("<f4"), ends)], names=["id", "good", "at", "value"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, at, value = [], [], []
        for batch in batches:
            label += batch.column(1).to_pylist()
            at += [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            value += [np.frombuffer(x, "<f4") for x in batch.column(3).to_pylist()]
        if not label:
            return
        scorer = Ftrl(1 << BITS, alpha=1.0, l1=0.3, l2=0.0)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in at])])
        scorer.fit(ends, np.concatenate(at), np.concatenate(value), np.array(label), EPOCHS)
        where, weight, bias = scorer.compact()
        yield pa.RecordBatch.from_arrays([pa.array([where.tobytes()]), pa.array([weight.tobytes()]), pa.array([bias])], names=["at", "weight", "bias"])

    # at most fit_rows ids: small enough to send to every task
    rows = own.join(F.broadcast(picked), "id").mapInArrow(hashed, f"id {kind}, good double, at binary, value binary")
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "good", "at").mapInArrow(train, "at binary, weight binary, bias double").collect()
    if found:
        model.at, model.weight, model.bias = np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score", weak_out: str | None = None) -> DataFrame:
    """docs with a column ``out``: the scorer's probability of a good document,
    and with ``weak_out`` the weak-label model's posterior of its votes.

    Null texts and texts without a word: 0. All rows and columns stay; columns
    of these two names are replaced.
    """
    @F.arrow_udf("score double, weak double")
    def probability(text: pa.Array) -> pa.Array:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.at] = model.weight
        good, weak = [np.zeros(0)], [np.zeros(0)]
        for _, texts in flat.chunks(text):
            n = len(texts)
            stats, words, spans = statistics(texts)
            doc, at, value = features(spans, n)
            good.append(np.where(words > 0, sigmoid(model.bias + np.bincount(doc, dense[at] * value, minlength=n)), 0.0))
            weak.append(np.where(words > 0, model.posterior(_patterns(votes(stats))), 0.0) if weak_out else np.zeros(n))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(good)), pa.array(np.concatenate(weak))], ["score", "weak"])

    name = "__quality"
    while name in docs.columns:
        name += "_"
    made = docs.withColumn(name, probability(F.col(text_col))).withColumn(out, F.col(f"{name}.score"))
    return (made.withColumn(weak_out, F.col(f"{name}.weak")) if weak_out else made).drop(name)
