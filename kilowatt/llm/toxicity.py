"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs and pairs with one word
between them, lower-cased and hashed. The weights are fitted in one task on a
bounded sample of the labelled rows (``FIT_ROWS`` rows, those with the smallest
hash of their id); L1 leaves few of them, so the model is a small array that
goes to every task. Every whole text is then scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilowatt.llm import flat
from kilowatt.llm.linear import Ftrl, sigmoid

#: At most so many labelled rows are used to fit the weights.
FIT_ROWS = 12_000
BITS = 20
EPOCHS = 4
#: Rate, and the summed gradient below which a weight is zero: more than what
#: the features of a single document gather in all epochs.
ALPHA, L1 = 3.0, 10.0

_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of words, pairs and skip-pairs; with repeats. A long
    text is taken in pieces, each with the two words that follow it."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > flat.CHUNK_BYTES:
        parts = [_distinct(*_features(part)) for part in flat.pieces(texts, 2)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _features(texts)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = flat.utf8(pc.utf8_lower(texts))
    starts, ends, doc = flat.alphanumeric_spans(raw, offsets)
    word = flat.span_hashes(raw, starts, ends)
    docs, hashes = [doc], [word]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        hashes.append(flat.mix(word[:-gap][same] * salt + word[gap:][same]))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc << BITS | at)
    return key >> BITS, key & ((1 << BITS) - 1)


def sample(labels: DataFrame, id_col: str, label_col: str, rows: int, where: Column | None = None) -> DataFrame:
    """(id, label) of at most ``rows`` labelled ids for which ``where`` holds, by the
    hash of the id. Null ids and labels are left out; of several labels of an id
    the largest holds."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    own = own if where is None else own.where(where)
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    return own.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        where: Column | None = None, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(coordinates, weights, bias) fitted on labelled rows of docs; None without any.

    where: a condition on ``id``, the rows to learn from. The result is bounded
    by 2**BITS weights. Null text is empty text.
    """
    picked = sample(labels, id_col, label_col, fit_rows, where)
    # at most fit_rows rows of two numbers: small enough to send to every task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                doc, at = _distinct(*features(texts))
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), batch.column(2).slice(row, len(texts)),
                     flat.binary_column(at.astype("<i4"), ends)], names=["id", "label", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts = [], []
        for batch in batches:
            label += batch.column(1).to_pylist()
            parts += [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
        if not label:
            return
        model = Ftrl(1 << BITS, alpha=ALPHA, l1=L1, l2=0.0)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        at = np.concatenate(parts)
        parts.clear()
        model.fit(ends, at, np.broadcast_to(np.float32(1), len(at)), np.array(label), EPOCHS)
        where_, weight, bias = model.compact()
        yield pa.RecordBatch.from_arrays([pa.array([where_.tobytes()]), pa.array([weight.tobytes()]), pa.array([bias])], names=["at", "weight", "bias"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(hashed, f"id {kind}, label double, at binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "at")
    found = made.mapInArrow(train, "at binary, weight binary, bias double").collect()
    if not found:
        return None
    return np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column ``out``: the probability of label 1, from 0 to 1.

    Null text is scored as empty text (the bias alone); without a model every
    score is 0. All rows and columns stay; a column called ``out`` is replaced.
    """
    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(text)))
        at, weight, bias = model
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weight
        parts = [np.zeros(0)]
        for _, texts in flat.chunks(text):
            doc, place = features(texts)
            hit = dense[place] != 0
            doc, place = _distinct(doc[hit], place[hit])
            parts.append(sigmoid(bias + np.bincount(doc, dense[place], minlength=len(texts))))
        return pa.array(np.concatenate(parts))

    return docs.withColumn(out, probability(F.col(text_col)))
