"""Mixing sources to target weights: exact length counts and a bounded knapsack.

1. Sizes: the words of every whole text are counted once; from there on a
   document is a narrow row (id, source, size). Sources are ordered by code
   point, the null source last.
2. Targets: a budget, ``BUDGET`` of all words, is shared by weight; a target stops
   at ``REPEATS`` times its source's words, and the excess is reshared by weight
   among the others until none is above. All of that is exact integer arithmetic
   over the table of sources, whatever their number.
3. Fit: a source takes whole passes first. What is left of its budget is fitted
   on its histogram (exact length, number of documents): the same share of
   each length, rounded down, then the longest lengths that still fit, and for
   the last ``HOLD`` words a bounded-knapsack dynamic program over the documents
   that are left and ``HOLD`` words of short ones given back. The histogram of a source of w words has at most sqrt(2 w)
   lengths, so a task never holds more than that.
4. Selection: of each (source, length) the fit says how many documents are
   taken once more, and the seeded hash of the ids says which. A group of n
   documents is cut at sqrt(n) hash buckets, and only the bucket that the cut
   falls into is ranked, so a length that a third of all documents have is
   never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed

WEIGHTS = (3, 1, 2)
#: Words taken of all sources together, over the words there are: numerator, denominator.
BUDGET = (3, 2)
#: A source, and so a document, is taken so often at most.
REPEATS = 2
#: Words of a source's budget that are left to the dynamic program.
HOLD = 1 << 15
#: Sums that the dynamic program keeps; beyond, it counts in larger units.
SUMS = 1 << 20
#: A plan of at most so many bytes is sent to every task; of a larger one only
#: the rows that stand for more than one in PLAN_ROWS of all documents, so fewer than that.
PLAN_BYTES = 16 << 20
PLAN_ROWS = 1_000

SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has; null: 0.
    Each run becomes one letter and the white space goes, so no list of words is built."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x")
    return F.length(F.regexp_replace(one, f"[{SPACE}]+", "")).cast("long")


def _ranked(sources: DataFrame, key: str) -> DataFrame:
    """sources with ``rank``, from 0 by ``key``: ranges of keys are numbered one by
    one and start where the rows of the ranges before them end."""
    dealt = checkpointed(sources.repartitionByRange(32, key).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    start, before = [], 0
    for part in sorted(sizes):
        start += [F.lit(part), F.lit(before)]
        before += sizes[part]
    if not start:
        return dealt.select(*sources.columns, F.lit(0).cast("long").alias("rank"))
    here = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return dealt.withColumn("rank", (here + F.create_map(*start)[F.col("part")]).cast("long")).drop("part")


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """sources (key, source_size) with ``target`` (double).

    Weights repeat along the order of the keys. A source is full where
    ``repeats`` times its size is below its weight's share; a round shares what
    the full ones leave among the others. Sums are exact; a target is rounded
    once. Sources without words, or no words at all: target 0.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(_ranked(sources, "key").withColumn("weight", weight.cast("long")))
    size, w = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(19,0)")
    row = ranked.agg(F.sum(size).alias("size"), F.sum("weight").alias("weight")).first()
    total = int(row["size"] or 0)
    # a share is above / below * weight; all words times the budget's numerator keep it whole
    above, below, full = budget[0] * total, budget[1] * int(row["weight"] or 1), 0
    while True:
        is_full = repeats * size * _whole(below) < w * _whole(above)
        row = ranked.where(is_full).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.sum("weight").alias("weight")).first()
        if row["n"] == full:
            break
        full = row["n"]
        left = int(ranked.agg(F.sum("weight").alias("weight")).first()["weight"]) - int(row["weight"])
        if not left:
            break
        above, below = budget[0] * total - budget[1] * repeats * int(row["size"]), budget[1] * left
    share = (w * _whole(above)).cast("double") / F.lit(float(below))
    return ranked.select("key", "source_size", F.when(is_full, (repeats * size).cast("double")).otherwise(share).alias("target"))


def fit(length: np.ndarray, count: np.ndarray, target: float, repeats: int = REPEATS, hold: int = HOLD, sums: int = SUMS) -> tuple[int, np.ndarray]:
    """(passes, extra): every document is taken ``passes`` times, and extra[i] of
    the count[i] documents of length[i] once more, so that the words taken come
    as near to target as the dynamic program finds."""
    total = int(sum(int(a) * int(b) for a, b in zip(length, count, strict=True)))
    extra = np.zeros(len(length), np.int64)
    passes = min(repeats, int(target // total)) if total else 0
    left = round(target) - passes * total
    if passes == repeats or left <= 0:
        return passes, extra
    order = np.argsort(-length, kind="stable")
    size, there = length[order].astype(np.int64), count[order].astype(np.int64)
    taken = np.floor(there * (left / total * (1 - 1e-9)) * (size > 0)).astype(np.int64)  # the same share of each length
    left -= int((size * taken).sum())
    free, short = there - taken, hold >> 6  # short ones are left to the last step: the rounding leaves short ** 2 / 2 words of them at most
    while left > hold:  # the longest that fit, then the next: the rest halves each round
        fits = (free > 0) & (size <= left - hold) & (size > short)
        if not fits.any():
            break
        most = np.where(fits, np.minimum(free, (left - hold) // np.maximum(size, 1)), 0)
        run = np.cumsum((size * most).astype(float))
        whole = np.where(run <= left - hold, most, 0)
        stop = int(np.argmax(run > left - hold)) if (run > left - hold).any() else len(run)
        whole[stop:] = 0
        if stop < len(run):
            whole[stop] = min(int(most[stop]), (left - hold - int((size * whole).sum())) // int(size[stop]))
        if not whole.any():
            break
        taken, free, left = taken + whole, free - whole, left - int((size * whole).sum())
    # some of the short ones taken are given back, so that the last step can exchange them
    back, copies, room = np.zeros(len(size), np.int64), 4, hold
    short_first = np.flatnonzero((size > 0) & (size <= hold))[::-1]
    while ((back < taken) & (size <= room))[short_first].any():
        for i in short_first:
            more = min(int(min(taken[i], copies) - back[i]), room // int(size[i]))
            back[i] += more
            room -= more * int(size[i])
        copies *= 4
    taken, free, left = taken - back, free + back, left + int((size * back).sum())
    extra[order] = taken + knapsack(size, free, left, sums)
    return passes, extra


def knapsack(size: np.ndarray, free: np.ndarray, left: int, sums: int = SUMS) -> np.ndarray:
    """How many of the free documents of each size to take so that their sizes
    sum up as near to ``left`` as can be (ties: below).

    The sums up to 2 * left are kept as one array of the item that reached each
    first; a size with n free documents is log2(n) items of 1, 2, 4, ... documents.
    It ends as soon as ``left`` itself is reached. More than ``sums`` sums are
    counted in larger units, without the short sizes; those then fill what is left.
    """
    unit = max(1, -(-2 * left // sums))
    if unit > 1 and (size > HOLD >> 6).any() and (size <= HOLD >> 6).any():
        out = knapsack(size, np.where(size > HOLD >> 6, free, 0), max(0, left - HOLD // 2), sums)
        rest = left - int((size * out).sum())
        return out + knapsack(size, free - out, rest, sums) if 0 < 2 * rest <= sums else out
    goal, most = left // unit, 2 * left // unit
    first = np.full(most + 1, -1, np.int32)
    first[0] = -2
    items: list[tuple[int, int, int]] = []
    for i in np.flatnonzero((free > 0) & (size > 0) & (size <= 2 * left))[::-1]:  # short ones first
        weight = max(1, round(int(size[i]) / unit))
        copies, step = min(int(free[i]), most // weight), 1
        while copies > 0 and first[goal] == -1:
            step = min(step, copies)
            if step * weight <= most:
                reached = (first[:most + 1 - step * weight] != -1) & (first[step * weight:] == -1)
                first[step * weight:][reached] = len(items)
                items.append((int(i), step, step * weight))
            copies, step = copies - step, 2 * step
        if first[goal] != -1:
            break
    out = np.zeros(len(size), np.int64)
    reached = np.flatnonzero(first != -1)
    at = int(reached[np.argmin(np.abs(reached - goal))])
    while first[at] >= 0:  # an item reached a sum only from one reached before it
        i, step, weight = items[first[at]]
        out[i] += step
        at -= weight
    return out


def _planned(rows: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """rows with the plan's columns of their (key, size): by a broadcast of the
    whole plan where its bytes are few; else the rows of the lengths that most
    documents have meet a broadcast, the others a shuffle, in which no key has
    more than one in PLAN_ROWS of all rows."""
    size = plan.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= PLAN_BYTES:
        return rows.join(F.broadcast(plan), ["key", "size"])
    hot = plan.where(F.col("n") > total // PLAN_ROWS)
    rest = rows.join(F.broadcast(hot.select("key", "size")), ["key", "size"], "left_anti")
    return rows.join(F.broadcast(hot), ["key", "size"]).unionByName(rest.join(plan, ["key", "size"]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row of docs.

    size: the words of the text (null or empty: 0); source_size and target:
    of the row's source; taken: the words the mix takes of the row, size times
    0 to ``repeats``. The choice follows from rows and seed alone. Rows that
    repeat an id are documents of their own; of equal ids of one source and
    size, or of null ids, it does not matter which is taken. An empty table
    gives an empty result; other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z"))  # null after all others
    place = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    sized = checkpointed(docs.select(F.col(id_col).alias("id"), key.alias("key"), words(F.col(text_col)).alias("size"), place.alias("place")))
    lengths = checkpointed(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    total = int(lengths.agg(F.sum("n")).first()[0] or 0)
    sources = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = checkpointed(targets(sources, weights, budget, repeats))

    def fitted(found: pa.Table) -> pa.Table:
        length, n = (found.column(c).to_numpy() for c in ("size", "n"))
        passes, extra = fit(length, n, found.column("target")[0].as_py(), repeats)
        return found.append_column("passes", pa.array(np.full(len(n), passes))).append_column("extra", pa.array(extra))

    plan = lengths.join(F.broadcast(aims) if aims.count() <= PLAN_ROWS else aims, "key").select("key", "size", "n", "source_size", "target")
    plan = checkpointed(plan.groupBy("key").applyInArrow(fitted, "key string, size long, n long, source_size long, target double, passes long, extra long"))

    # groups of which a part is taken: in which hash bucket the cut falls, and how many rows of it are taken
    buckets = F.ceil(F.sqrt("n")).cast("long")
    some = plan.where("extra > 0 AND extra < n")
    dealt = _planned(sized.select("key", "size", "place"), some.select("key", "size", "n"), total)
    filled = dealt.groupBy("key", "size", F.pmod("place", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("here"))
    run = F.sum("here").over(W.partitionBy("key", "size").orderBy("bucket"))
    cut = _planned(filled.withColumn("run", run), some.select("key", "size", "n", "extra"), total).where("run > extra AND run - here <= extra")
    cut = cut.select("key", "size", F.col("bucket").alias("cut"), (F.col("extra") - F.col("run") + F.col("here")).alias("inside"))
    plan = checkpointed(plan.join(cut, ["key", "size"], "left"))

    rows = _planned(sized, plan, total)
    bucket = F.pmod("place", buckets)
    at_cut = F.coalesce(bucket == F.col("cut"), F.lit(False))
    once = F.when(F.col("cut").isNull(), F.col("extra") > 0).otherwise(bucket < F.col("cut"))
    within = F.row_number().over(W.partitionBy("key", "size").orderBy("place", "id")) <= F.col("inside")
    chosen = rows.where(~at_cut).withColumn("once", once).unionByName(rows.where(at_cut).withColumn("once", within))
    taken = F.col("size") * (F.col("passes") + F.col("once").cast("long"))
    return chosen.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
