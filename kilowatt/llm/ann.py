"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample of the distinct vectors (``SAMPLE``
of them, by their hash): a node is split at the median along the line through
two of its vectors, down to ``LEAF`` sample vectors. Every vector is then put
into one leaf of each tree. A query searches all trees through one priority
queue, the branch nearest to it first (by its largest distance from a split on
the way there), until the leaves it has opened hold ``SHARE`` of the sample,
and at least ``LEAST`` sample vectors; copies are one vector there and use up
nothing of that. Vectors and queries meet by leaf, and the distances of the
candidates are exact. Of equal vectors only the rows with the k + 1 smallest
ids are candidates; no other copy can be among the k nearest of any query.

A leaf with many vectors is cut into parts of ``PART`` rows; its queries go to
each. A task returns the best of each query, not its candidates.

SHARE: the test data's vectors have no structure beside their copies, so ten
nearest are found only in many leaves; the tests measure the recall.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed
from kilowatt.llm.vectors import matrix, usable

TREES = 16
SAMPLE = 16_384
LEAF = 32
SHARE = 0.5
LEAST = 4_096
PART = 4_096
#: Queries that one task searches the forest for, in so many tasks at most.
ASK, ASK_TASKS = 64, 10_000


class Forest:
    """Random-projection trees over a sample, and their search."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.length = sample.shape[1]
        self.size = len(sample)
        # a node is (normal, threshold, left, right), a leaf (its number, sample members)
        self.nodes: list[tuple] = []
        self.members: list[np.ndarray] = []
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(rows) > leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if not length > 0:  # equal vectors: any direction
                normal = rng.normal(size=self.length)
                length = np.linalg.norm(normal)
            normal = normal / length
            place = sample[rows] @ normal
            at = np.median(place)
            left, right = rows[place <= at], rows[place > at]
            if len(left) and len(right):
                self.nodes[me] = (normal, at, self._grow(sample, left, leaf, rng), self._grow(sample, right, leaf, rng))
                return me
        self.nodes[me] = (len(self.members), rows)
        self.members.append(rows)
        return me

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf numbers of the rows, a column for each tree."""
        out = np.zeros((len(rows), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(rows)))]
            while todo:
                k, mine = todo.pop()
                node = self.nodes[k]
                if len(node) == 2:
                    out[mine, t] = node[0]
                elif len(mine):
                    left = rows[mine] @ node[0] <= node[1]
                    todo += [(node[2], mine[left]), (node[3], mine[~left])]
        return out

    def search(self, query: np.ndarray, share: float = SHARE, least: int = LEAST) -> list[int]:
        """The leaves to open, the nearest first."""
        wanted = min(self.size, max(least, int(np.ceil(share * self.size))))
        seen = np.zeros(self.size, bool)
        queue = [(-np.inf, t, root) for t, root in enumerate(self.roots)]
        opened: list[int] = []
        while queue and int(seen.sum()) < wanted:
            far, t, k = heapq.heappop(queue)
            node = self.nodes[k]
            while len(node) == 4:
                apart = float(query @ node[0] - node[1])
                near, other = (node[2], node[3]) if apart <= 0 else (node[3], node[2])
                heapq.heappush(queue, (max(far, abs(apart)), t, other))
                node = self.nodes[near]
            opened.append(node[0])
            seen[node[1]] = True
        return opened


#: 96 bits of its numbers name a vector.
_NAME = ("h1", "h2")


def _named(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest over at most ``sample`` of the distinct usable vectors (id,
    vector), all of the most frequent length; None without any."""
    length = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    if length is None:
        return None
    named = _named(vectors.where(F.size("vector") == length["length"]))
    # names alone are sorted, so only the vectors picked are moved; copies meet in partial sums
    names = named.select(*_NAME).distinct().orderBy(*_NAME).limit(sample)
    picked = named.join(F.broadcast(names), [*_NAME], "left_semi").groupBy(*_NAME).agg(F.any_value("vector").alias("vector")).orderBy(*_NAME).select("vector").toArrow()
    return Forest(matrix(picked.column("vector").combine_chunks()))


def search(df: DataFrame, is_query: "F.Column", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, found
    through the forest; fewer only if there are fewer rows.

    is_query: a condition on ``id`` that names the queries, rows of df
    themselves. score: the Euclidean distance in double precision; ties go to
    the smaller id. A query is no candidate of its own. Vectors that are null,
    empty or zero or hold null or non-finite numbers, and vectors of another
    length than most have, take no part, nor do rows with a null id. Rows that
    repeat an id are one candidate, at the smallest distance; a repeated query
    is one query. Other columns are not read.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    kind = df.schema[id_col].dataType.simpleString()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    forest = fit(own)
    if forest is None:
        return df.sparkSession.createDataFrame([], result)
    own = own.where(F.size("vector") == forest.length)
    copy = F.dense_rank().over(W.partitionBy(*_NAME).orderBy("id"))  # its limit is applied before the shuffle too
    candidates = checkpointed(_named(own).withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "vector"))
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(forest)  # at most SAMPLE vectors and as many splits for each tree

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.value.members), np.int64)
        for batch in batches:
            total += np.bincount(model.value.leaves(matrix(batch.column(0))).reshape(-1), minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["leaf", "n"])

    counted = candidates.select("vector").mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # a row for each leaf of the forest
    parts = np.ones(len(forest.members), np.int64)
    for row in counted:
        parts[row["leaf"]] = -(-row["n"] // PART)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = model.value.leaves(matrix(part.column(1)))
                trees = found.shape[1]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), trees)))
                leaf = found.reshape(-1)
                salt = rows.column(2).to_numpy() % parts[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), rows.column(0), rows.column(1)], names=["leaf", "part", "id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                opened = [model.value.search(q) for q in matrix(part.column(1))]
                leaf = np.array([x for o in opened for x in o], np.int32)
                which = np.repeat(np.arange(part.num_rows), [len(o) for o in opened])
                which, salt, leaf = (np.repeat(which, parts[leaf]), np.concatenate([np.arange(p) for p in parts[leaf]]) if len(leaf) else np.zeros(0, np.int64),
                                     np.repeat(leaf, parts[leaf]))
                rows = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), rows.column(0), rows.column(1)], names=["leaf", "part", "id", "vector"])

    def nearest(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asked, found, apart = [], [], []
        if candidates.num_rows and queries.num_rows:
            rows, name = matrix(candidates.column("vector").combine_chunks()), candidates.column("id").to_numpy()
            repeated = len(np.unique(name)) < len(name)
            for q, vector in zip(queries.column("id").to_numpy(), matrix(queries.column("vector").combine_chunks()), strict=True):
                other = name != q
                distance = np.sqrt(((rows[other] - vector) ** 2).sum(1))
                theirs = name[other]
                if repeated:  # an id once, at its smallest distance
                    order = np.lexsort((distance, theirs))
                    theirs, once = np.unique(theirs[order], return_index=True)
                    distance = distance[order][once]
                if len(theirs) > k:
                    near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                    near = near[np.lexsort((theirs[near], distance[near]))][:k]
                    distance, theirs = distance[near], theirs[near]
                asked.append(np.full(len(theirs), q))
                found.append(theirs)
                apart.append(distance)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(join(asked, np.int64), id_type), "vec_id": pa.array(join(found, np.int64), id_type), "score": pa.array(join(apart, float))})

    id_type = pa.int64() if kind == "bigint" else pa.int32()
    vector_type = df.schema[vector_col].dataType.simpleString()
    schema = f"leaf int, part long, id {kind}, vector {vector_type}"
    placed = candidates.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")).mapInArrow(place, schema)
    queries = checkpointed(own.where(is_query).dropDuplicates(["id"]).select("id", "vector"))
    tasks = min(max(1, -(-queries.count() // ASK)), ASK_TASKS)  # a search costs far more than its row weighs
    asked = queries.repartition(tasks, "id").mapInArrow(ask, schema)
    met = placed.groupBy("leaf", "part").cogroup(asked.groupBy("leaf", "part")).applyInArrow(nearest, f"query_id {kind}, vec_id {kind}, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
