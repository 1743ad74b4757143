"""Language identification: rank-order n-gram profiles and out-of-place distance.

N-grams are of one to three characters of a text's lower-cased words, a word
padded with one blank at either end. A profile is the list of the ``TOP`` most
frequent n-grams, the most frequent first (ties: by code points). The distance
of a text to a language is the sum over the text's own profile of how far each
n-gram is out of place in the language's; one that is not there counts
``TOP``. The nearest language wins.

Every n-gram of a whole text is counted: the code points of a chunk of texts
become one array of numbers (text, n-gram), and one sort counts them. The
language profiles are fitted on a bounded sample, ``ROWS_PER_LANGUAGE`` rows
of each language by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.llm import flat
from kilowatt.llm.bpe import LETTER, classes
from kilowatt.llm.shared import checkpointed, look_up

TOP = 300
#: About so many rows of each language are used to fit its profile.
ROWS_PER_LANGUAGE = 4_000
#: A sample of at most so many (id, language) rows is sent to every task.
BROADCAST_ROWS = 200_000
UNKNOWN = "und"


def grams(texts: pa.Array, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), sorted by group and n-gram; a text's group is
    its number, or group[number]. An n-gram is three code points of 21 bits, the
    unused ones 0, the padding a blank. A long text is counted in pieces."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > flat.CHUNK_BYTES:
        gram, count = flat.add_up(_grams(part, None)[1:] for part in flat.pieces(texts))
        return np.full(len(gram), 0 if group is None else group[0]), gram, count
    return _grams(texts, group)


def _grams(texts: pa.Array, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    words = pc.utf8_lower(texts).to_pylist()
    group = np.arange(n) if group is None else group
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.append(0, group), np.append(1, [len(w) + 1 for w in words]))
    letter = classes()[points] == LETTER
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    points, owner, letter = points[keep], owner[keep], letter[keep]
    # symbols of this chunk: 1 the blank, then its letters by code point
    there = np.zeros(0x110000, bool)
    there[points[letter]] = True
    symbols = np.flatnonzero(there)
    bits = int(len(symbols) + 2).bit_length()
    if 3 * bits + int(group.max() if n else 0).bit_length() > 62 and n > 1 and group[0] != group[-1]:
        half = n // 2
        parts = [_grams(texts.slice(0, half), group[:half]), _grams(texts.slice(half), group[half:])]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    code = np.cumsum(there, dtype=np.int64) + 1
    s = np.where(letter, code[points], 1)
    one = owner[letter] << 3 * bits | s[letter] << 2 * bits
    two_at = np.flatnonzero(letter[:-1] | letter[1:])
    two_owner = np.where(letter[two_at], owner[two_at], owner[two_at + 1])
    two = two_owner << 3 * bits | s[two_at] << 2 * bits | s[two_at + 1] << bits
    mid = np.flatnonzero(letter[1:-1]) + 1
    three = owner[mid] << 3 * bits | s[mid - 1] << 2 * bits | s[mid] << bits | s[mid + 1]
    key = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    back = np.concatenate([[0, 32], symbols]).astype(np.int64)
    mask = (1 << bits) - 1
    gram = back[key >> 2 * bits & mask] << 42 | back[key >> bits & mask] << 21 | back[key & mask]
    return key >> 3 * bits, gram, count


def profiles(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank from 0) of the ``top`` most frequent n-grams of each owner."""
    if not len(owner):
        return owner, gram, owner
    index_bits = int(len(owner)).bit_length()
    count_bits = int(count.max()).bit_length()
    if index_bits + count_bits + int(owner.max()).bit_length() > 62:
        order = np.lexsort((np.arange(len(owner)), -count, owner))
    else:
        order = np.sort(owner << (index_bits + count_bits) | (count.max() - count) << index_bits | np.arange(len(owner))) & ((1 << index_bits) - 1)
    owner, gram = owner[order], gram[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank < top
    return owner[keep], gram[keep], rank[keep]


class Profiles:
    """N-grams of all languages, sorted, and their rank in each language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.languages)), TOP, np.int32)
        for language, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.languages.index(language)] = rank

    def nearest(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text, and its score."""
        n = len(texts)
        owner, gram, rank = profiles(*grams(texts))
        size = np.bincount(owner, minlength=n)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == gram
        best, which = np.full(n, np.inf), np.zeros(n, np.int64)
        for k in range(len(self.languages)):
            theirs = self.ranks[at, k]
            apart = np.where(known & (theirs < TOP), np.abs(theirs - rank), TOP)
            distance = np.bincount(owner, apart, n)
            nearer = distance < best
            best, which = np.where(nearer, distance, best), np.where(nearer, k, which)
        score = np.where(size > 0, 1.0 - best / (TOP * np.maximum(size, 1)), 0.0)
        return [self.languages[k] if s else UNKNOWN for k, s in zip(which, size, strict=True)], score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Profiles:
    """Profiles of the languages named in ``lang_col``; rows with a null id, text
    or language teach nothing. where: a condition on ``id``, the rows to learn
    from. No such rows: no languages. The result has ``TOP`` n-grams for each
    language."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    own = own if where is None else own.where(where)
    sizes = checkpointed(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    named = own.select("id", "lang")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(ROWS_PER_LANGUAGE << 30)) / F.col("n")
    picked = checkpointed(look_up(named, sizes, "lang").where(share).select("id", "lang").distinct())
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    rows = own.join(picked, ["id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                names = batch.column(0).slice(row, len(texts)).to_pylist()
                order = sorted(range(len(names)), key=names.__getitem__)
                known = sorted(set(names))
                group = np.array([known.index(names[i]) for i in order])
                owner, gram, n = grams(texts.take(pa.array(order)), group)
                for k, name in enumerate(known):
                    mine = owner == k
                    old = totals.get(name, (gram[:0], n[:0]))
                    every, place = np.unique(np.concatenate([old[0], gram[mine]]), return_inverse=True)
                    totals[name] = every, np.bincount(place, np.concatenate([old[1], n[mine]]), len(every)).astype(np.int64)
        for name, (gram, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram", "rank").collect()
    return Profiles([(r["lang"], r["gram"], r["rank"] - 1) for r in best])


def identify(docs: DataFrame, known: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row of docs.

    score: 1 minus the distance over the largest possible one. A null text, a
    text without a letter, or no known language: ``und`` and 0. Ties go to
    the first language by name. Null and repeated ids pass through; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                names, score = known.nearest(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")
