"""Exact top items of factor models, and ranking metrics (DAT2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.operators.partitioning import materialize

#: Items that are sent to the tasks at once, and of them compared at once.
BLOCK_ITEMS = 1 << 16
STEP = 256
#: Parts into which a user's items are hashed before they are ranked.
USER_PARTS = 64


def _rows(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), rank)


def top_items(users: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """(user, rank, item, score, compared): the n items of largest inner product of
    each user, exact; ties go to the smaller item. compared: how many items the
    user was compared with.

    users, items: (id long, features array). Items are ordered by their length,
    the longest first, in blocks of about ``BLOCK_ITEMS`` that go to the tasks one
    after another. By Cauchy and Schwarz no item of a block scores more than the
    user's length times the block's longest, so a user whose n-th score is above
    that is done: it leaves, and a run of blocks ends with its last user. No pair
    of user and item is a row. Null ids or features are left out, and users
    of another length than the items have no items; a user has fewer
    than n items only if there are fewer.
    """
    own = items.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).dropna()
    size = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v))
    own = materialize(own.withColumn("size", size))
    count = own.count()
    kind = "user long, rank int, item long, score double, compared long"
    if not count:
        return users.sparkSession.createDataFrame([], kind)
    rank = own.select(F.size("features")).first()[0]
    blocks, step = -(-count // BLOCK_ITEMS), STEP
    bounds = own.select(F.percentile_approx("size", [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted({float(b) for b in bounds}, reverse=True)
    state = users.select(F.col("id").cast("long").alias("user"), F.col("features").cast("array<double>").alias("features")).dropna()
    state = state.where(F.size("features") == rank).select(
        "*", F.array().cast("array<struct<score:double,item:long>>").alias("best"), F.lit(0).cast("long").alias("compared"), F.lit(False).alias("done"))
    schema = "user long, features array<double>, best array<struct<score:double,item:long>>, compared long, done boolean"
    finished: DataFrame | None = None
    edges = [float("inf"), *cuts, -1.0]
    for high, low in zip(edges, edges[1:], strict=False):
        part = own.where((F.col("size") <= high) & (F.col("size") > low))
        pieces = max(1, -(-part.count() // BLOCK_ITEMS))  # many items of one length
        for piece in range(pieces):
            found = part.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece).orderBy(F.col("size").desc(), "id").toArrow()
            block = _rows(found.column("features").combine_chunks(), rank), found.column("id").to_numpy(), found.column("size").to_numpy()
            model = users.sparkSession.sparkContext.broadcast(block)

            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                vectors, names, sizes = model.value  # noqa: B023
                for batch in batches:
                    for at in range(0, batch.num_rows, 1024):
                        rows = batch.slice(at, 1024)
                        yield _searched(rows, _rows(rows.column(1), rank), vectors, names, sizes, n, step)

            after = materialize(state.mapInArrow(search, schema))
            ended = after.where("done")
            finished = ended if finished is None else finished.unionByName(ended)
            state = after.where("NOT done")
            if state.isEmpty():
                break
        if state.isEmpty():
            break
    every = finished.unionByName(state)
    return every.select("user", F.posexplode("best").alias("rank", "b"), "compared").select(
        "user", (F.col("rank") + 1).alias("rank"), F.col("b.item").alias("item"), F.col("b.score").alias("score"), "compared")


def _searched(rows: pa.RecordBatch, users: np.ndarray, vectors: np.ndarray, names: np.ndarray, sizes: np.ndarray, n: int, step: int) -> pa.RecordBatch:
    """The users' best items among those they have and a block's, and who is done with all shorter items."""
    held = rows.column(2)
    count = np.diff(held.offsets.to_numpy())
    score, item = np.full((len(users), n), -np.inf), np.full((len(users), n), np.iinfo(np.int64).max)
    flat, place = held.flatten(), np.arange(n)[None, :] < count[:, None]
    score[place], item[place] = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    length = np.linalg.norm(users, axis=1)
    compared = rows.column(3).to_numpy().copy()
    open_ = np.arange(len(users))
    for at in range(0, len(names), step):
        # rounding may lift a product a little over the bound
        open_ = open_[score[open_, -1] <= length[open_] * sizes[at] * (1 + 1e-12)]
        if not len(open_):
            break
        mine = vectors[at:at + step]
        both = np.concatenate([score[open_], users[open_] @ mine.T], axis=1)
        known = np.concatenate([item[open_], np.broadcast_to(names[at:at + step], (len(open_), len(mine)))], axis=1)
        order = np.lexsort((known, -both))[:, :n]
        score[open_], item[open_] = np.take_along_axis(both, order, 1), np.take_along_axis(known, order, 1)
        compared[open_] += len(mine)
    last = sizes[-1] if len(sizes) else np.inf
    done = score[:, -1] > length * last * (1 + 1e-12)
    has = score > -np.inf
    ends = np.append(0, np.cumsum(has.sum(1))).astype(np.int32)
    best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(score[has]), pa.array(item[has])], ["score", "item"]))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), best, pa.array(compared), pa.array(done)], names=["user", "features", "best", "compared", "done"])


def ranking_metrics(scored: DataFrame, relevant: DataFrame, user: str, item: str, score: str, k: int = 10, partitions: int | None = None) -> DataFrame:
    """One row (n_users, precision_at_k, map_at_k, ndcg_at_k) of scored items
    against relevant ones, the mean over users with a relevant item.

    A user's list is the k items of largest score (ties: the smaller item).
    precision: hits / k; average precision: the sum over hits of the precision up
    to there, over the lesser of k and the relevant items; gain of place i: 1 /
    log2(i + 1), over that of the best order. A user without a list counts 0;
    pairs that repeat count once, at their largest score. Nulls are left out.

    Rows are dealt into ``partitions`` (default: the session's shuffle partitions)
    by number, which adaptive execution does not merge: it goes by compressed
    bytes, and sorted keys unpack to many times those. Give a number that follows
    the rows. A user's items are limited to k in each of ``USER_PARTS`` hash
    parts first, so a user with very many is not one task.
    """
    n = partitions or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(item), F.lit(USER_PARTS)).alias("__part")
    lists = scored.select(user, part, item, F.col(score).alias("score")).dropna().repartition(n, user, "__part")
    lists = lists.groupBy(user, "__part", item).agg(F.max("score").alias("score"))
    for keys in ([user, "__part"], [user]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), item))
        lists = lists.withColumn("place", place).where(F.col("place") <= k)
        lists = lists.repartition(n, user) if len(keys) == 2 else lists
    wanted = relevant.select(user, item).dropna().repartition(n, user, item).distinct()
    hits = lists.select(user, item, "place").repartition(n, user, item).join(wanted, [user, item]).select(user, "place")
    # a user has k hits at most
    nth = F.row_number().over(W.partitionBy(user).orderBy("place"))
    per = hits.withColumn("nth", nth).groupBy(user).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("nth") / F.col("place")).alias("precisions"), F.sum(1 / F.log2(F.col("place") + 1.0)).alias("gain"))
    users = wanted.groupBy(user).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("most")).join(per, user, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("most").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return users.agg(
        F.count(F.lit(1)).alias("n_users"), F.avg(zero(F.col("hits") / k)).alias("precision_at_k"),
        F.avg(zero(F.col("precisions") / F.col("most"))).alias("map_at_k"), F.avg(zero(F.col("gain") / ideal)).alias("ndcg_at_k"))
