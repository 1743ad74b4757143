"""Near-duplicate documents: ProbMinHash signatures, banding, verification.

A document is its weighted set of word shingles (five words, lower-cased and
without ASCII signs; the weight is how often a shingle occurs; a shorter text
is one shingle). The similarity of two documents is the probability Jaccard
of these weights: the sum over common shingles d of 1 / sum over all shingles
e of max(a(e) / a(d), b(e) / b(d)); with equal weights it is the Jaccard
similarity.

1. Signatures: every shingle is a Poisson process of rate its weight, seeded
   by the shingle; each arrival goes to a random register, which keeps the
   earliest. A shingle stops as soon as its time is past the latest register
   (early termination). Registers of two documents agree with the probability
   of their similarity.
2. Banding: documents that agree in all registers of a band share a bucket.
   64 registers in 16 bands of 4 miss a pair of similarity 0.8 with
   probability 0.0002, one of 0.9 with 1e-7.
3. Verification: the exact similarity of the texts, never the estimate,
   decides. Equal texts are one class from the start. In each bucket the
   classes are first compared with one leader, not with each other, and each
   bucket has its own. Buckets of three or more classes that are not in one
   component after that are compared as a whole, in blocks of bounded size:
   a task multiplies the incidence matrices of two blocks and returns the
   edges of a spanning forest, never pairs. So most buckets of n copies cost
   n comparisons, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilowatt.llm import flat
from kilowatt.llm.shared import checkpointed, connected_components, look_up, spanning_forest

THRESHOLD = 0.8
#: What a sum of shares may lose by rounding; a similarity of exactly 0.8 links.
ROUNDING = 1e-9
SHINGLE_WORDS = 5
BANDS, ROWS = 16, 4
#: Classes, and bytes of text, in a block of a bucket that is compared as a whole.
BLOCK_CLASSES, BLOCK_BYTES = 256, 1 << 20
#: Pairs of one leader that are verified together; each such group has a copy of the leader's text.
LEADER_PAIRS = 256
#: A list of up to so many classes is sent to every task to pick their texts; a longer one is joined by a shuffle.
BROADCAST_CLASSES = 200_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of each distinct shingle, sorted by
    text and hash; a text of fewer than ``width`` words is one shingle, a text
    without words has none. A long text is taken in pieces, each with the words
    that its last shingles reach."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))]
    for row, some in flat.chunks(texts):
        found = _long(some, width) if len(some) == 1 and pc.binary_length(some)[0].as_py() > flat.CHUNK_BYTES else None
        doc, element, weight = found or _shingles(some, width)
        parts.append((doc + row, element, weight))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _long(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The shingles of one text by pieces; None if no piece has ``width`` words, so that the text is one shingle."""
    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.zeros(0, np.uint64), np.zeros(0)
        for part in flat.pieces(text, width - 1):
            if len(flat.alphanumeric_spans(*flat.utf8(part))[0]) >= width:
                yield _shingles(part, width)[1:]

    element, weight = flat.add_up(parts())
    return (np.zeros(len(element), np.int64), element, weight) if len(element) else None


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = flat.utf8(pc.utf8_lower(texts))
    starts, ends, doc = flat.alphanumeric_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    words = flat.span_hashes(raw, starts, ends)
    n = len(words)
    per_doc = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(per_doc)
    room = last[doc] - np.arange(n)  # words from here to the text's end
    first = np.arange(n) == last[doc] - per_doc[doc]
    size = np.minimum(per_doc[doc], width)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        ahead = np.zeros(n, np.uint64)
        ahead[:max(n - k, 0)] = words[k:]
        total = total * _STEP + np.where(room > k, ahead, np.uint64(k))
    keep = (room >= width) | (first & (size < width))
    doc, total = doc[keep], flat.mix(total[keep])
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return doc[at], total[at], np.diff(np.append(at, len(doc))).astype(float)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash: the winning element of every register, a row for each text.
    Texts without elements have a row of zeros."""
    time = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    at = np.zeros(len(element))
    active = np.arange(len(element))
    latest = np.full(texts, np.inf)
    arrival = 0
    while len(active):
        arrival += 1
        bits = flat.mix(element[active] + np.uint64(arrival * int(_GOLD) % 2**64))
        unit = ((bits >> np.uint64(11)).astype(float) + 1) * 2.0**-53
        at[active] -= np.log(unit) / weight[active]
        active, bits = (x[at[active] < latest[doc[active]]] for x in (active, bits))
        slot = doc[active] * registers + (flat.mix(bits ^ _STEP) % np.uint64(registers)).astype(np.int64)
        now = at[active]
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        winner[slot[won]] = element[active[won]]
        latest = time.reshape(texts, registers).max(1)
        active = active[now < latest[doc[active]]]
    return winner.reshape(texts, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sorted (element, weight) sets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][at_a], b[1][at_b]
    # sum over e of max(a(e) / a(d), b(e) / b(d)): where a(e) / b(e) > a(d) / b(d), the first is larger
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    high = np.searchsorted(ratio, ratio, "right")
    sum_a = np.append(np.cumsum(wa[::-1])[::-1], 0.0)[high]
    sum_b = np.append(0.0, np.cumsum(wb))[high]
    return float((1.0 / ((only_a + sum_a) / wa + (only_b + sum_b) / wb)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, content, text) -> (id, content, size, bands)."""
    for batch in batches:
        for row, texts in flat.chunks(batch.column(2)):
            doc, element, weight = shingles(texts)
            n = len(texts)
            rows = signatures(doc, element, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (n, BANDS)).copy()
            for k in range(ROWS):
                key = flat.mix(key * _STEP + rows[:, :, k])
            none = np.bincount(doc, minlength=n) == 0
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[~none].reshape(-1).view(np.int64)))
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n), batch.column(1).slice(row, n), size, bands], names=["id", "content", "size", "bands"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, similarity)."""
    held: tuple = (None, None)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out = np.zeros(len(keys))
        for row, texts in flat.chunks(batch.column(3)):
            doc, element, weight = shingles(texts)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                at = row + i
                if held[0] != keys[at]:
                    held = (keys[at], shingles(batch.column(2).slice(at, 1).cast(pa.large_string()))[1:])
                out[at] = similarity(held[1], (element[ends[i]:ends[i + 1]], weight[ends[i]:ends[i + 1]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])


def linked(texts: pa.Array, other: np.ndarray | None = None, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of texts are at least ``threshold`` similar, as a symmetric matrix.

    other: a mark for each text; pairs with equal marks are left out. With p the
    shares of a text's shingles, the similarity is at most the sum of p over
    the common ones, on either side: one product of matrices gives that bound
    for all pairs. Where no shingle of either text repeats it gives the
    similarity itself; elsewhere it is computed for the pairs the bound allows.
    """
    n = len(texts)
    doc, element, weight = shingles(texts)
    ends = np.searchsorted(doc, np.arange(n + 1))
    size, total = np.diff(ends), np.bincount(doc, weight, n)
    plain = np.bincount(doc, weight != 1, n) == 0
    _, place, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[place] > 1  # what a single text holds is common to no pair
    column = (np.cumsum(count > 1) - 1)[place]
    share = np.zeros((n, n))
    width = int((count > 1).sum())
    for at in range(0, width, 4096):
        here = shared & (column >= at) & (column < at + 4096)
        there = np.zeros((n, min(4096, width - at)), np.float32)
        there[doc[here], column[here] - at] = weight[here]
        share += there @ (there > 0).astype(np.float32).T
    common = share  # for plain texts, the number of common shingles
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.nan_to_num(share / total[:, None])
        exact = np.nan_to_num(common / (size[:, None] + size[None, :] - common))
    near = np.minimum(bound, bound.T) >= threshold - ROUNDING
    both = plain[:, None] & plain[None, :]
    near[both] = exact[both] >= threshold - ROUNDING
    if other is not None:
        near &= other[:, None] != other[None, :]
    np.fill_diagonal(near, False)
    for i, j in np.argwhere(np.triu(near & ~both)):
        a, b = (slice(ends[k], ends[k + 1]) for k in (i, j))
        near[i, j] = near[j, i] = similarity((element[a], weight[a]), (element[b], weight[b])) >= threshold - ROUNDING
    return near


def _link_blocks(threshold: float):
    """A bucket, or a pair of its blocks -> (a, b) edges of a spanning forest of its links."""
    def link(table: pa.Table) -> pa.Table:
        content = table.column("content").combine_chunks()
        mark = table.column("block").to_numpy() if table.column("low")[0] != table.column("high")[0] else None
        near = linked(table.column("text").combine_chunks().cast(pa.large_string()), mark, threshold)
        a, b = spanning_forest(near)
        return pa.table({"a": content.take(pa.array(a)), "b": content.take(pa.array(b))})

    return link


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts are at least that similar. The
    pairs of a class that leads many are spread over groups of about LEADER_PAIRS,
    each with a copy of its text, so no task gets all of them."""
    parts = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_PAIRS).alias("parts")))
    salted = look_up(pairs, parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    left = salted.select("a", "salt").distinct().join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a")
    right = salted.join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compare, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold - ROUNDING).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    leaders: bool = True) -> DataFrame:
    """(id_col, class_id, group_id, kept) of every row of df.

    class_id: the smallest id among the rows with the same text; group_id:
    the smallest id that can be reached by links of similarity >= threshold;
    kept: id = group_id. A null text is in no class and no group: it is its
    own, and kept. Texts without a word are linked with equal texts only.
    Rows with a null id take part, order after all others and are kept only if
    the text is null; repeated rows give repeated rows. Other columns are not
    read, so their names are free.
    """
    rows = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("content"), F.col(text_col).alias("text"))
    signed, classes, groups = duplicate_classes(rows, threshold, leaders)
    out = checkpointed(classes.join(groups, "content", "left").select("content", "first", F.coalesce("group_first", "first").alias("group_first")))
    told = look_up(signed.select("id", "content"), out, "content").select(
        F.col("id").alias(id_col), F.col("first").alias("class_id"), F.col("group_first").alias("group_id"),
        F.coalesce(F.col("id") == F.col("group_first"), F.lit(False)).alias("kept"))
    alone = rows.where("content IS NULL").select("id")
    return told.unionByName(alone.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(True).alias("kept")))


def duplicate_classes(rows: DataFrame, threshold: float = THRESHOLD, leaders: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, content, text): the signed rows (id, content, size, bands), the classes
    (content, first), and for classes in a group of more than one (content, component, group_first).

    leaders: begin with the comparison with leaders; the groups are the same without it.
    """
    kind = rows.schema["id"].dataType.simpleString()
    signed = checkpointed(rows.where("content IS NOT NULL").mapInArrow(_sign, f"id {kind}, content binary, size long, bands array<long>"))
    classes = checkpointed(signed.groupBy("content").agg(F.min("id").alias("first"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    banded = classes.select("content", "first", "size", F.explode("bands").alias("band"))
    shared = checkpointed(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = checkpointed(look_up(banded, shared, "band"))
    wanted = checkpointed(members.groupBy("content").agg(F.first("first").alias("first")))
    few = wanted.count() <= BROADCAST_CLASSES
    # one row has the text of a class: that with its smallest id (its copies are equal), so copies do not meet in a shuffle
    first = wanted.select(F.col("content").alias("own"), "first")
    same = (F.col("content") == F.col("own")) & F.col("id").eqNullSafe(F.col("first"))
    found = rows.where("content IS NOT NULL").join(F.broadcast(first) if few else first, same)
    texts = checkpointed(found.groupBy("content").agg(F.any_value("text").alias("text")))

    links = components = None
    named = members.select("band", "content", "size", "n", F.col("content").alias("component"))
    if leaders:
        lead = checkpointed(members.groupBy("band").agg(F.min_by("content", F.xxhash64("content", "band")).alias("lead")))
        pairs = look_up(members, lead, "band").where("content <> lead").select(F.col("lead").alias("p"), F.col("content").alias("q"))
        # a pair once, however it is met, with the end that leads first
        pairs = pairs.groupBy(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).agg(F.min("p").alias("a"))
        pairs = checkpointed(pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")))
        links = checkpointed(_verified(pairs, texts, threshold))
        components = connected_components(links)
        named = members.where("n > 2").join(components.withColumnRenamed("node", "content"), "content", "left").select(
            "band", "content", "size", "n", F.coalesce("component", "content").alias("component"))
    # buckets that the leaders left in several components, cut into blocks
    still = checkpointed(named.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).alias("blocks")).where("least <> most").select("band", "blocks"))
    block = F.pmod(F.xxhash64("content"), F.col("blocks"))
    placed = checkpointed(look_up(named.select("band", "content"), still, "band").select(
        "band", "content", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")))
    if not placed.isEmpty():
        placed = placed.select("band", "content", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        more = placed.join(texts, "content").groupBy("band", "low", "high").applyInArrow(_link_blocks(threshold), "a binary, b binary")
        more = checkpointed(more.distinct())
        if not more.isEmpty():
            components = connected_components(more if links is None else links.unionByName(more))
    if components is None:
        none = classes.select("content", F.col("content").alias("component"), F.col("first").alias("group_first")).limit(0)
        return signed, classes.select("content", "first"), none
    grouped = checkpointed(components.join(classes.select(F.col("content").alias("node"), "first"), "node"))
    firsts = checkpointed(grouped.groupBy("component").agg(F.min("first").alias("group_first")))
    groups = look_up(grouped, firsts, "component").select(F.col("node").alias("content"), "component", "group_first")
    return signed, classes.select("content", "first"), groups


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with one row of each group of near-duplicates: that with the smallest id.

    Groups are those of ``near_duplicates``. Of repeated rows (equal id and
    text) one stays; if all ids of a text are null, one of its rows stays.
    Rows with a null text are kept. The columns are those of df, whatever
    their names.
    """
    key = "content"
    while key in df.columns:
        key = "_" + key
    keyed = df.withColumn(key, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("content"), F.col(text_col).alias("text"))
    _, classes, groups = duplicate_classes(rows, threshold)
    # of classes with one first id in a group (an id with two texts) the least stays
    lead = classes.join(groups.select("content", "component"), "content").groupBy("component").agg(
        F.min_by("content", F.struct(F.col("first").isNull(), "first", "content")).alias("content"))
    grouped = groups.select("content").join(lead.select("content"), "content", "left_anti")
    stay = checkpointed(classes.join(grouped, "content", "left_anti"))
    named = keyed.join(stay.where("first IS NOT NULL").select(F.col("content").alias(key), F.col("first").alias(id_col)), [key, id_col])
    nameless = keyed.where(F.col(id_col).isNull()).join(stay.where("first IS NULL").select(F.col("content").alias(key)), key)
    out = named.dropDuplicates([key, id_col]).select(df.columns)
    out = out.unionByName(nameless.dropDuplicates([key]).select(df.columns))
    return out.unionByName(df.where(F.col(text_col).isNull()))
