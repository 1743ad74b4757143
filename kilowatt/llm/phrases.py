"""Phrase collocations: best-first branch-and-bound growth over prefix counts.

A phrase is two to four words of one piece of a text. Phrases grow a word at a
time, to the right from their prefix and to the left from their suffix, and
counts of what they grow from bound what they can reach. A phrase p with a = f(p)
and first word u has, at the cut after u, r >= a, so

    score(p) <= 2000000 a / (f(u) + a) <= 2000000 f(q) / (f(u) + f(q))

for each prefix q of p: the prefix's forward bound. Its suffixes have a
backward bound, with the last word. A phrase of m + 1 words is counted only
where the bound of its prefix or of its suffix of m words reaches the
language's threshold, and all its words and pairs occur ``LEAST`` times. What
is left out then

- scores below the threshold itself, as each of its parts' bounds does,
- is no part that a phrase at or above the threshold is cut into, and
- drops no such phrase: an extension of it has it as a prefix or a suffix, and a
  phrase's bounds are at least its score. (Longer phrases need no look: an
  extension by one word is in each of them, and at least as frequent.)

So all phrases at or above the threshold are settled: their scores and which of
them survive are exact. The frontier is opened best first: the threshold of
the first round is the ``OPEN``-th best score of the language's pairs, and where
fewer than ``TOP`` phrases survive at or above it, the next round opens
``WIDEN`` times as many; a language whose frontier is all open, or whose ``TOP``-th
surviving score (ties included) is settled, is done.

Counting: tasks hash the words of whole texts, a slice at a time, and count runs
of word numbers in numpy before anything is shuffled. A word's number is a
64-bit hash of language and word; two words of one number are found when words
are counted, and another seed is taken. Which pairs and triples are open
reaches the tasks as a bitmap of a fixed largest size; a wrong bit lets a
phrase be counted that need not be, never the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.llm import flat
from kilowatt.llm.shared import checkpointed

LEAST = 30
WORDS = 4
TOP = 2_000
#: An extension with this share (in hundredths) of a phrase's occurrences drops it.
COVERED = 80
SCORE = 2_000_000
UNKNOWN = "und"
#: Pairs whose scores open the frontier in the first round, and how many times more in the next.
OPEN = 2 * TOP
WIDEN = 4
#: Bytes of text hashed at once, and rows of counts kept in a task before they are handed on.
SLICE = 1 << 19
KEPT = 1 << 20
#: Bits of a bitmap: 16 for each key, between these powers of two (32 MB at most).
BITS = (16, 28)

_U = np.uint64
#: Kinds of bytes: 0 inside a word, 1 blank, 2 parts pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets of texts, words seen before) of consecutive rows.

    A text longer than ``size`` comes in slices of its own, cut between words; each but the first
    begins with the last WORDS - 1 words of the one before it.
    """
    for row, texts in flat.chunks(column, size):
        raw, offsets = flat.utf8(texts)
        if len(texts) > 1 or len(raw) <= size:
            yield row, _LOWER[raw], offsets, 0
            continue
        begin, fresh, seen = 0, 0, 0
        while fresh < len(raw):
            stop = min(fresh + size, len(raw))
            while stop < len(raw):
                signs = np.flatnonzero(_KIND[raw[fresh + 1:stop]])
                if len(signs):
                    stop = fresh + 1 + int(signs[-1])
                    break
                stop = min(stop + size, len(raw))  # within one long word
            part = _LOWER[raw[begin:stop]]
            yield row, part, np.array([0, len(part)]), seen
            starts, _, _ = flat.spans(_KIND[part] == 0, np.array([0, len(part)]))
            seen = min(WORDS - 1, len(starts))
            begin, fresh = begin + int(starts[-seen]) if seen else stop, stop


class Text:
    """The words of a slice: their numbers, and which stand next to each other."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, language: np.ndarray, seen: int, seed: int):
        kind = _KIND[raw]
        self.raw, self.language, self.seen = raw, language, seen
        self.starts, self.ends, owner = flat.spans(kind == 0, offsets)
        self.owner = owner
        h = flat.span_hashes(raw, self.starts, self.ends)
        self.word = flat.mix(h + flat.mix(language[owner] + _U(2 * seed + 1))).view(np.int64)
        # no sign between the end of a word and the start of the next
        signs = np.append(0, np.cumsum(kind == 2))
        self.next = (owner[1:] == owner[:-1]) & (signs[self.starts[1:]] == signs[self.ends[:-1]])

    def unlike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions in a and b at which the words or their languages differ."""
        length = self.ends[a] - self.starts[a]
        same = (length == self.ends[b] - self.starts[b]) & (self.language[self.owner[a]] == self.language[self.owner[b]])
        size = np.where(same, length, 0)
        apart = self.raw[flat.gather_index(self.starts[a], size)] != self.raw[flat.gather_index(self.starts[b], size)]
        same[np.repeat(np.arange(len(a)), size)[apart]] = False
        return np.flatnonzero(~same)

    def runs(self, m: int) -> np.ndarray:
        """First positions of all runs of m words of one piece that end in a new word."""
        n = len(self.word) - m + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(n, bool)
        for k in range(m - 1):
            whole &= self.next[k:k + n]
        whole[:max(0, self.seen - m + 1)] = False
        return np.flatnonzero(whole)


def key(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the word numbers of each row."""
    h = words[0].view(np.uint64)
    for w in words[1:]:
        h = flat.mix(h * _U(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return h


class Counts:
    """Counts of equal rows of word numbers, merged whenever KEPT rows have come."""

    def __init__(self, width: int):
        self.width = width
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, columns: list[np.ndarray]) -> None:
        """Rows that each count once."""
        if len(columns[0]):
            self.parts.append(np.column_stack([*columns, np.ones(len(columns[0]), np.int64)]))
            self.size += len(columns[0])

    def merge(self) -> None:
        """Equal rows become one. Rows are sorted by their hash; where different
        rows share one, by all their numbers."""
        if not self.parts:
            return
        rows = np.concatenate(self.parts)
        names = rows[:, :self.width]
        h = key([np.ascontiguousarray(names[:, k]) for k in range(self.width)])
        order = np.argsort(h)
        rows, h = rows[order], h[order]
        new = np.append(True, (rows[1:, :self.width] != rows[:-1, :self.width]).any(1))
        if (new[1:] & (h[1:] == h[:-1])).any():
            rows = rows[np.lexsort([rows[:, k] for k in range(self.width)])]
            new = np.append(True, (rows[1:, :self.width] != rows[:-1, :self.width]).any(1))
        first = np.flatnonzero(new)
        merged = rows[first]
        merged[:, -1] = np.add.reduceat(rows[:, -1], first)
        self.parts, self.size = [merged], len(merged)

    def batches(self, names: list[str], last: bool) -> Iterator[pa.RecordBatch]:
        """What is handed on: all at the end, or when merging does not make room."""
        if self.size > KEPT or last:
            self.merge()
        if self.parts and (last or self.size > KEPT // 2):
            rows = self.parts[0]
            for at in range(0, len(rows), 1 << 16):
                part = rows[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, k])) for k in range(self.width + 1)], names=names)
            self.parts, self.size = [], 0


class Bitmap:
    """A set of 64-bit hashes, two bits each; may hold more than was put in."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = _places(h, self.bits)
        one = lambda at: (self.words[at >> _U(6)] >> (at & _U(63))) & _U(1)
        return (one(a) & one(b)).astype(bool)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> _U(64 - bits), flat.mix(h + _U(1)) >> _U(64 - bits)


def bitmap(rows: DataFrame, columns: list[str]) -> Bitmap:
    """The rows' word numbers as a bitmap; what reaches the driver is its non-empty
    words, 1 / 64 of its bits at most."""
    bits = min(max((16 * rows.count()).bit_length(), BITS[0]), BITS[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(key([batch.column(k).to_numpy() for k in range(batch.num_columns)]), bits))
            word = (at >> _U(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["word", "mask"])

    found = rows.select(*columns).mapInArrow(placed, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Bitmap(bits, words)


def _languages(column: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = column.dictionary_encode()
    raw, offsets = flat.utf8(coded.dictionary.cast(pa.large_string()))
    h = flat.span_hashes(np.append(raw, np.uint8(0)), offsets[:-1], offsets[1:]) if len(offsets) > 1 else np.zeros(0, np.uint64)
    return h[coded.indices.to_numpy()]


def _texts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Text, pa.Array]]:
    for batch in batches:
        language = _languages(batch.column(0))
        for row, raw, offsets, seen in slices(batch.column(1)):
            yield Text(raw, offsets, language[row:row + len(offsets) - 1], seen, seed), batch.column(0).slice(row, len(offsets) - 1)


def count_words(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(word, lang, name, f): every word's number and how often it occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, language in _texts(batches, seed):
            at = text.runs(1)
            if not len(at):
                continue
            word, first, which, n = np.unique(text.word[at], return_index=True, return_inverse=True, return_counts=True)
            other = text.unlike(at, at[first][which])  # of another spelling than the first word of its number
            n -= np.bincount(which[other], minlength=len(n))
            word, first, n = np.append(word, text.word[at[other]]), np.append(at[first], at[other]), np.append(n, np.ones(len(other), np.int64))
            length = text.ends[first] - text.starts[first]
            letters = np.ascontiguousarray(text.raw[flat.gather_index(text.starts[first], length)])
            bounds = np.append(0, np.cumsum(length)).astype(np.int32)
            names = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
            yield pa.RecordBatch.from_arrays([pa.array(word), language.take(pa.array(text.owner[first])), names, pa.array(n)], names=["word", "lang", "name", "f"])

    return texts.mapInArrow(count, "word long, lang string, name string, f long").groupBy("word", "lang", "name").agg(F.sum("f").alias("f"))


def count_runs(texts: DataFrame, m: int, seed: int, sets: list[tuple[int, int, Broadcast]], opens: list[tuple[int, int, Broadcast]]) -> DataFrame:
    """(w1 .. wm, f) of the runs of m words that occur LEAST times.

    sets: (first, length, bitmap): parts of a run that must be in the bitmap;
    opens: the same, one of which must be (if there are any).
    """
    names = [f"w{k + 1}" for k in range(m)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(m)
        for text, _ in _texts(batches, seed):
            at = text.runs(m)
            has = lambda first, length, known, at: known.value.has(key([text.word[at + k] for k in range(first, first + length)]))
            for first, length, known in sets:
                at = at[has(first, length, known, at)]
            if opens:
                wanted = np.zeros(len(at), bool)
                for first, length, known in opens:
                    wanted |= has(first, length, known, at)
                at = at[wanted]
            total.add([text.word[at + k] for k in range(m)])
            if total.size > KEPT:
                yield from total.batches([*names, "f"], False)
        yield from total.batches([*names, "f"], True)

    rows = texts.mapInArrow(count, ", ".join(f"{x} long" for x in [*names, "f"]))
    return rows.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def score(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)), exact beyond 64 bits."""
    return F.expr(f"(CAST({SCORE} AS DECIMAL(8,0)) * CAST({a} AS DECIMAL(19,0))) div (CAST({left} AS DECIMAL(19,0)) + CAST({right} AS DECIMAL(19,0)))")


def _threshold(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, floor): the score of the lang's ``wanted``-th best row, 0 if it has not so
    many. Rows become one for each score first, 1,000,001 a language at most."""
    each = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("here"))
    run = each.withColumn("run", F.sum("here").over(W.partitionBy("lang").orderBy(F.col("score").desc())))
    best = run.join(wanted, "lang").where("run >= wanted").groupBy("lang").agg(F.max("score").alias("floor"))
    return wanted.join(best, "lang", "left").select("lang", "wanted", F.coalesce("floor", F.lit(0)).alias("floor"))


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df for a join, sent to every task if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _of(texts: DataFrame, languages: DataFrame) -> DataFrame:
    """The texts of the languages, if these are few; the bitmaps alone keep the others out."""
    return texts.join(F.broadcast(languages.select("lang")), "lang", "left_semi") if languages.count() <= 100_000 else texts


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, opened: int = OPEN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best surviving phrases of
    each language, by score and a descending, then phrase.

    a: occurrences of the phrase; l, r: of the two parts of its lowest-scoring
    cut (ties: the earliest); n: words of the language. A null text is
    empty, a null language ``und``. Repeated rows count each time; a language
    without candidates has no rows, nor has an empty table. Other columns are
    not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).where("length(text) > 0")
    seed = 0
    while True:
        words = checkpointed(count_words(texts, seed))
        if words.groupBy("word").agg(F.count(F.lit(1)).alias("names")).where("names > 1").isEmpty():
            break
        seed += 1
    sizes = checkpointed(words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = checkpointed(words.where(F.col("f") >= LEAST).select("word", "lang", "name", "f"))
    send = spark.sparkContext.broadcast
    known = send(bitmap(words, ["word"]))
    pairs = count_runs(texts, 2, seed, [(0, 1, known), (1, 1, known)], [])
    one = _small(words)
    pairs = (pairs.join(one.select(F.col("word").alias("w1"), "lang", F.col("f").alias("f1")), "w1")
             .join(one.select(F.col("word").alias("w2"), F.col("f").alias("f2")), "w2"))
    pairs = checkpointed(pairs.select("lang", "w1", "w2", "f", "f1", "f2", score("f", "f1", "f2").alias("score"),
                                      score("f", "f", "f1").alias("forward"), score("f", "f", "f2").alias("backward")))
    frequent = send(bitmap(pairs, ["w1", "w2"]))
    two = [(k, 2, frequent) for k in range(WORDS - 1)]

    done: DataFrame | None = None
    wanted = pairs.select("lang").distinct().select("lang", F.lit(opened).cast("long").alias("wanted"))
    while True:
        floors = checkpointed(_threshold(pairs, wanted))
        here = _small(floors.select("lang", "floor"))
        mine = pairs.join(here, "lang")
        left = texts if done is None else _of(texts, floors)
        open2 = [send(bitmap(mine.where(f"{bound} >= floor"), ["w1", "w2"])) for bound in ("forward", "backward")]
        triples = count_runs(left, 3, seed, two[:2], [(0, 2, open2[0]), (1, 2, open2[1])])
        ends = one.select(F.col("word").alias("w3"), F.col("f").alias("f3"))
        firsts = one.select(F.col("word").alias("w1"), "lang", F.col("f").alias("f1"))
        triples = triples.join(firsts, "w1").join(ends, "w3")
        inner = pairs.select("w1", "w2", "f")
        triples = (triples.join(inner.withColumnRenamed("f", "f12"), ["w1", "w2"])
                   .join(inner.toDF("w2", "w3", "f23"), ["w2", "w3"]))
        triples = checkpointed(triples.select("lang", "w1", "w2", "w3", "f", "f1", "f23", "f12", "f3",
                                              score("f", "f", "f1").alias("forward"), score("f", "f", "f3").alias("backward")))
        grown = triples.join(here, "lang")
        open3 = [send(bitmap(grown.where(f"{bound} >= floor"), ["w1", "w2", "w3"])) for bound in ("forward", "backward")]
        quads = checkpointed(count_runs(left, 4, seed, two, [(0, 3, open3[0]), (1, 3, open3[1])]))

        found = _scored(pairs, triples, quads, one).join(here, "lang").where("score >= floor")
        kept = checkpointed(_surviving(found, triples, quads))
        enough = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
        state = floors.join(enough, "lang", "left").withColumn("done", (F.col("floor") == 0) | (F.coalesce("kept", F.lit(0)) >= top))
        state = checkpointed(state)
        settled = kept.join(_small(state.where("done").select("lang")), "lang", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        wanted = checkpointed(state.where("NOT done").select("lang", (F.col("wanted") * WIDEN).alias("wanted")))
        if wanted.isEmpty():
            break
    return _best(done, one, sizes, top)


def _scored(pairs: DataFrame, triples: DataFrame, quads: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1 .. w4, a, l, r, score) of all phrases counted whose parts are known,
    at their lowest-scoring cut, the earliest of equals."""
    none = F.lit(None).cast("long")
    of = words.select("word", "lang", "f")
    quads = quads.join(of.select(F.col("word").alias("w1"), "lang", F.col("f").alias("f1")), "w1").join(of.select(F.col("word").alias("w4"), F.col("f").alias("f4")), "w4")
    pair, triple = pairs.select("w1", "w2", "f"), triples.select("w1", "w2", "w3", "f")
    quads = (quads.join(pair.withColumnRenamed("f", "f12"), ["w1", "w2"]).join(pair.toDF("w3", "w4", "f34"), ["w3", "w4"])
             .join(triple.withColumnRenamed("f", "f123"), ["w1", "w2", "w3"]).join(triple.toDF("w2", "w3", "w4", "f234"), ["w2", "w3", "w4"]))
    cuts = {2: [("f1", "f2")], 3: [("f1", "f23"), ("f12", "f3")], 4: [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]}
    parts = []
    for m, df in ((2, pairs.drop("score")), (3, triples), (4, quads)):
        each = [F.struct(score("f", a, b).alias("score"), F.lit(k).alias("cut"), F.col(a).alias("l"), F.col(b).alias("r")) for k, (a, b) in enumerate(cuts[m], 1)]
        lowest = F.least(*each) if len(each) > 1 else each[0]
        row = df.withColumn("low", lowest)
        parts.append(row.select("lang", *[F.col(f"w{k}") if k <= m else none.alias(f"w{k}") for k in range(1, WORDS + 1)], F.col("f").alias("a"), "low.l", "low.r", "low.score"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _surviving(found: DataFrame, triples: DataFrame, quads: DataFrame) -> DataFrame:
    """Without the phrases that an extension by one word covers."""
    words = [f"w{k}" for k in range(1, WORDS + 1)]
    none = F.lit(None).cast("long")

    def parts(df: DataFrame, m: int) -> DataFrame:
        inside = [F.struct(*[F.col(f"w{first + k}") if k < m - 1 else none for k in range(WORDS)]) for first in (1, 2)]
        each = df.select("f", F.explode(F.array(*[x.cast("struct<w1:long,w2:long,w3:long,w4:long>") for x in inside])).alias("p"))
        return each.select("f", *[F.col(f"p.{w}") for w in words])

    longer = parts(triples, 3).unionByName(parts(quads, 4)).groupBy(*words).agg(F.max("f").alias("f"))
    same = [found[w].eqNullSafe(longer[w]) for w in words]
    covered = F.expr(f"CAST(100 AS DECIMAL(8,0)) * CAST(f AS DECIMAL(19,0)) >= CAST({COVERED} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))")
    return found.join(longer, [*same, covered], "left_anti").select("lang", *words, "a", "l", "r", "score")


def _best(kept: DataFrame, words: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their words. Those with more than
    ``top`` better ones by (score, a) need no words."""
    better = F.rank().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))
    named = kept.withColumn("better", better).where(F.col("better") <= top).drop("better")
    for k in range(1, WORDS + 1):
        named = named.join(words.select(F.col("word").alias(f"w{k}"), F.col("name").alias(f"n{k}")), f"w{k}", "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"n{k}" for k in range(1, WORDS + 1)]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
