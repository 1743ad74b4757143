"""Reliable checkpoints in the folder that the session names, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the session's shared checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``; only a session that has none, as in
    a local test, gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; local sessions without one get a new one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset; name a folder that all executors share")
    return tempfile.mkdtemp(prefix="kilowatt-llm-")


def spanning_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) positions of the edges of a star for each component of the graph
    with the symmetric matrix ``near``, a its first position."""
    left = near.any(1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while left.any():
        first = int(left.argmax())
        inside = np.zeros(len(near), bool)
        inside[first] = True
        new = inside
        while new.any():
            new = near[new].any(0) & ~inside
            inside = inside | new
        left &= ~inside
        inside[first] = False
        b.append(np.flatnonzero(inside))
        a.append(np.full(len(b[-1]), first))
    return np.concatenate(a), np.concatenate(b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task -> as few edges with the same components: a star
    from the least node of each component of the task's edges."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    kinds = [f.type for f in batch.schema] if parent else []
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 1 << 14):
        part = nodes[at:at + (1 << 14)]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], kinds[0]), pa.array(part, kinds[1])], names=["a", "b"])


#: Edges that one task contracts, and what share of them must be left for another time.
TASK_EDGES = 1 << 16
SHRUNK = 0.7
#: A table of at most so many rows is sent to every task for a look-up.
BROADCAST_ROWS = 200_000
#: Of a longer one only the rows whose key more than one in HOT of the asking rows have, so fewer than that.
HOT = 1_000


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner", few: bool | None = None) -> DataFrame:
    """rows joined ("inner" or "left") with a table that has each key once: a key that many rows
    have is never gathered in one task, its row goes to them instead. The table is
    read more than once, and so are the rows if it is long. few: whether it has up
    to BROADCAST_ROWS rows, if that is known."""
    keys = [key] if isinstance(key, str) else key
    if table.count() <= BROADCAST_ROWS if few is None else few:
        return rows.join(F.broadcast(table), keys, how)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).persist()
    most = int(sizes.agg(F.sum("__rows")).first()[0] or 0) // HOT
    hot = checkpointed(sizes.where(F.col("__rows") > most).select(*keys))
    sizes.unpersist()
    rest = rows.join(F.broadcast(hot), keys, "left_anti")
    return rows.join(F.broadcast(hot.join(table, keys, how)), keys).unionByName(rest.join(table, keys, how))


def _round(e: DataFrame, labels: DataFrame, kind: str, few: bool) -> DataFrame:
    """(node, component, was): each node and its label get the least label that a neighbour of the node has, then the label of
    that label."""
    heard = look_up(e, labels.select(F.col("node").alias("v"), "component"), "v", few=few).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
    told = labels.join(heard, "node")
    own = told.select("node", F.least("component", "heard").alias("component"), F.col("component").alias("was"))
    hooked = told.where("heard < component").select(F.col("component").alias("node"), F.col("heard").alias("component"), F.lit(None).cast(kind).alias("was"))
    low = checkpointed(own.unionByName(hooked).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was")))
    jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return checkpointed(look_up(low, jump, "component", few=few).select("node", F.col("next").alias("component"), "was"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is
    the smallest node that can be reached.

    The edges of each task are first replaced by a spanning star of their
    components, and what is left is dealt to tasks of TASK_EDGES edges again as
    long as that shrinks it; edges that fit one such task are settled there. Then
    each round gives a node, and the node it is labelled with, the
    least label among its neighbours', and both the label of that label. So whole
    labelled groups are hooked onto each other, and a chain of n nodes needs about
    log2 n rounds. Minima are partial aggregations and look-ups send the rows
    of frequent keys out: neither the neighbours of one node nor the nodes of
    one component meet in a task. Edges with a null end are left out; an empty
    edge table has no nodes.
    """
    kind = edges.schema[a].dataType.simpleString()
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    schema = f"a {kind}, b {kind}"
    e = checkpointed(e.mapInArrow(_contract, schema))
    left, before = e.count(), None
    while before is None or left < SHRUNK * before:
        tasks, before = -(-left // TASK_EDGES), left
        if tasks <= 1:
            star = checkpointed(e.repartition(1).mapInArrow(_contract, schema))
            return star.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                star.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        e = checkpointed(e.repartition(tasks, "a", "b").mapInArrow(_contract, schema))
        left = e.count()
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    e = checkpointed(e.select(both.alias("e")).select("e.u", "e.v"))
    labels = checkpointed(e.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    few = labels.count() <= BROADCAST_ROWS
    while True:
        after = _round(e, labels, kind, few)
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
