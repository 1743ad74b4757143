"""PageRank over an edge list with DataFrames (DAT1), and the power iteration of
similarity graphs (DAT5), which runs the same way.

The edge table is shuffled once, to (src, salt), sorted and persisted; a node's
degree is kept with its rank, not with its edges. Each round shuffles ranks to
the edges, joins, and aggregates on the receiving node (map-side combined, so a
heavily linked node costs one row per partition). Each
round's ranks are persisted, since the next round reads them twice, and
every ``checkpoint_every`` rounds they are written to the session's shared
checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kilowatt.operators.partitioning import materialize

#: Parts into which a source's edges are hashed before its degree is known.
DEGREE_PARTS = 1024


def salted_links(edges: DataFrame, heavy_degree: int) -> DataFrame:
    """(src, dst, deg, salt, parts) of distinct edges (src, dst).

    A source with more than ``heavy_degree`` out-edges is spread over
    ``parts = ceil(deg / heavy_degree)`` salts by the hash of dst, so a
    (src, salt) has about ``heavy_degree`` edges however many the source
    has. The degree itself is found and joined over ``DEGREE_PARTS`` hash
    parts of each source, never by a join on src alone.
    """
    part = F.pmod(F.xxhash64("dst"), F.lit(DEGREE_PARTS)).alias("part")
    e = edges.select("src", "dst", part)
    per_part = e.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    degree = per_part.groupBy("src").agg(F.sum("n").alias("deg"))  # at most DEGREE_PARTS rows a source
    known = per_part.select("src", "part").join(degree, "src")
    parts = F.ceil(F.col("deg") / F.lit(int(heavy_degree))).cast("int")
    return e.join(known, ["src", "part"]).select(
        "src", "dst", F.col("deg").cast("double").alias("deg"), parts.alias("parts")
    ).withColumn("salt", F.pmod(F.hash("dst"), F.col("parts")))


def with_salts(edges: DataFrame, heavy_degree: int) -> DataFrame:
    """``edges`` (src, dst, ...) with ``parts`` and ``salt``: a source of more than
    ``heavy_degree`` rows is spread over parts = ceil(rows / heavy_degree) salts
    by the hash of dst, any other has one.

    Rows are counted, not distinct edges: the counts are added up before they
    are shuffled. There is at most one heavy source for each ``heavy_degree``
    rows, so their list is sent to every task, and the edges are not shuffled.
    """
    rows = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > int(heavy_degree))
    heavy = materialize(rows.select("src", F.ceil(F.col("n") / F.lit(int(heavy_degree))).cast("int").alias("heavy_parts")))
    parts = F.coalesce("heavy_parts", F.lit(1)).alias("parts")
    return edges.join(F.broadcast(heavy), "src", "left").select(*edges.columns, parts).withColumn(
        "salt", F.pmod(F.hash("dst"), F.col("parts")))


def pagerank(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    rounds: int = 5,
    damping: float = 0.85,
    checkpoint_every: int = 3,
    heavy_degree: int = 100_000,
) -> DataFrame:
    """Classic un-normalised PageRank: r' = (1 - d) + d * sum(r_in / outdeg_in).

    Duplicate edges are merged; every node that appears in an edge takes
    part. Dangling nodes (no out-edges) pass nothing on. Edges with a null
    end are left out. ``heavy_degree`` only sets how edges are spread (see
    :func:`with_salts`); ranks do not depend on it.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # read twice, to count and to place them: what made them runs once
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(
        F.col("src").isNotNull() & F.col("dst").isNotNull()
    ).persist(StorageLevel.MEMORY_AND_DISK)
    # copies of an edge share their salt, so they are merged where they lie; in
    # the order of the join, so that no round sorts them
    links = with_salts(e, heavy_degree).repartition(n, "src", "salt").distinct().sortWithinPartitions(
        "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    # every node once, with its out-edges and the number of salts its rank is copied to
    ends = links.groupBy("src", "salt").agg(F.count(F.lit(1)).alias("deg"), F.max("parts").alias("parts")).select(
        F.col("src").alias("node"), "deg", "parts"
    ).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("deg"), F.lit(1).alias("parts")))
    ranks = materialize(ends.groupBy("node").agg(F.sum("deg").alias("deg"), F.max("parts").alias("parts")).withColumn("rank", F.lit(1.0)))
    e.unpersist()
    held: list[DataFrame] = []
    for i in range(1, int(rounds) + 1):
        salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
        copies = ranks.where("deg > 0").select(F.col("node").alias("src"), salts, (F.col("rank") / F.col("deg")).alias("c"))
        flows = links.join(copies, ["src", "salt"]).select(
            F.col("dst").alias("node"), "c", F.lit(0).cast("long").alias("deg"), F.lit(1).alias("parts")
        )
        # every node also sends itself a zero, so one aggregation on the node
        # both sums the inflow and keeps nodes without in-edges (no join)
        keep = ranks.select("node", F.lit(0.0).alias("c"), "deg", "parts")
        ranks = flows.unionByName(keep).groupBy("node").agg(
            F.sum("c").alias("c"), F.max("deg").alias("deg"), F.max("parts").alias("parts")
        ).select("node", "deg", "parts", (F.lit(1.0 - damping) + F.lit(damping) * F.col("c")).alias("rank"))
        last = i == int(rounds)
        if last or (checkpoint_every and i % int(checkpoint_every) == 0):
            ranks = materialize(ranks)
            for frame in held:
                frame.unpersist()
            held = []
        else:
            ranks = ranks.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(ranks)
    links.unpersist()
    return ranks.select("node", "rank")


def power_iteration(similarities: DataFrame, rounds: int, heavy_degree: int = 100_000) -> DataFrame:
    """(node, value) after ``rounds`` rounds of v' = W v / |W v| at most, from the
    degrees, as ``PowerIterationClustering`` has them: its stopping rule, too.

    similarities: (src, dst, weight), each pair once in either direction; stored,
    as it is read twice. W is the similarity over the degree of the receiving
    node. Pairs of a node with itself are left out. A null, or a negative weight, is
    an error. No task holds the graph: edges are sorted runs, spilled
    and stored as rows, and a node's inflow is partial sums.
    """
    n = int(similarities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    valid = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("weight") >= 0)
    weight = F.when(valid, F.col("weight")).otherwise(F.raise_error(F.lit("a pair must have two ids and a similarity that is not negative")))
    both = similarities.where("src IS NULL OR dst IS NULL OR src <> dst").select(ends, weight.alias("weight")).select("e.src", "e.dst", "weight")
    links = with_salts(both, heavy_degree).repartition(n, "src", "salt").sortWithinPartitions("src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    nodes = links.groupBy("src", "salt").agg(F.sum("weight").alias("deg"), F.max("parts").alias("parts")).groupBy(
        F.col("src").alias("node")).agg(F.sum("deg").alias("deg"), F.max("parts").alias("parts"))
    state = materialize(nodes)
    total, many = state.agg(F.sum("deg"), F.count(F.lit(1))).first()
    state = state.withColumn("value", F.col("deg") / F.lit(total))
    least, before, change = max(1e-5 / max(many, 1), 1e-8), math.inf, math.inf
    for _ in range(int(rounds)):
        if change <= least:
            break
        salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
        copies = state.select(F.col("node").alias("src"), salts, "value")
        inflow = links.join(copies, ["src", "salt"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("value")).alias("heard"))
        told = materialize(state.join(inflow, "node").withColumn("heard", F.col("heard") / F.greatest("deg", F.lit(sys.float_info.epsilon))))
        norm = told.agg(F.sum(F.abs("heard"))).first()[0]
        value = F.col("heard") / F.lit(norm)
        delta = told.agg(F.sum(F.abs(value - F.col("value")))).first()[0]
        change, before = abs(delta - before), delta
        state = told.select("node", "deg", "parts", value.alias("value"))
    links.unpersist()
    return state.select("node", "value")
