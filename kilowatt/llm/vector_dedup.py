"""Near-duplicate vectors: a forest of random-projection trees with spill.

Vectors are compared only within a label (and length). Equal vectors are one
from the start, with their number. A label is compared whole as long as that is
less work than the copies that trees would make of it; there no pair can be
lost. In a larger label every tree splits a node of more than
``LEAF`` vectors at a quantile of their projections on one of the level's
random directions: the one, and the quantile near the median, around which
the fewest vectors lie. Vectors within the spill zone of the split go to both
sides. A split halves the node at most; nodes around whose every quantile
too many vectors lie are leaves of any size. A narrow zone makes few copies a
tree but needs more trees: the width (one of ``SPILLS``) and the number of trees
follow from the label's size, as those with the fewest copies of a vector that
lose a pair with a probability of ``MISS``.

Within a leaf all vectors are compared in tiles by matrix products, in single
precision first; only counts and the edges of a spanning forest leave the task,
never pairs. Leaves and whole labels are cut into blocks of ``BLOCK`` vectors,
and each pair of blocks is a group of its own. A pair that shares several leaves
is counted in the one with the least name.

All levels are aggregations and joins over narrow rows; node tables are sent
to the tasks only while they are small.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed, connected_components, look_up, spanning_forest
from kilowatt.llm.vectors import matrix, unit, usable

COSINE = 0.93
#: Directions of a tree, and how many of them a level has to choose from; a direction
#: that split a node before lies denser there, so the next levels take others.
DIRECTIONS, CHOICE = 24, 4
#: Vectors in a leaf: comparing one with so many costs about what carrying a copy of it through a tree does. And
#: vectors, of up to SHORT numbers, in a block of a leaf; of longer ones a block has fewer.
LEAF, BLOCK, SHORT = 16_384, 8192, 64
#: A label is split if it has more vectors than a vector's copies would be compared with and cost: each
#: copy counts as a leaf for itself and one for its comparisons, where a label compared whole has half its size.
WHOLE = 4
#: Vectors of a block that are compared with as many of another at once; and how many near pairs are linked one by one.
TILE, SPARSE = 1024, 4096
#: A pair at the threshold is lost with this probability at most; and so many trees at least.
MISS, TREES = 1e-6, 4
#: Half the spill zone, in standard deviations of the projected difference of two vectors at the threshold.
SPILLS = (0.15, 0.25, 0.35, 0.5, 0.75)
#: A level shrinks a node by so much less than a split at the median would.
SLACK = 0.93
#: Of 19 quantiles, at most so many may lie in the spill zone of a split.
ZONE = 8
#: Vectors whose projections a task holds at once.
PROJECTED = 1024
#: A table of up to so many nodes is sent to every task; a larger one is joined by a shuffle.
BROADCAST_NODES = 50_000


def _directions(length: int, trees: int) -> np.ndarray:
    """trees x DIRECTIONS unit vectors; those of a tree are a function of the length alone."""
    return unit(np.random.default_rng(length).normal(size=(trees * DIRECTIONS, length)))


def _plan(size: "F.Column") -> "F.Column":
    """(copies, trees, spill) of a label of more than LEAF vectors: the spill zone with the fewest copies of a
    vector, and the trees that it needs, by the label's depth, so that all lose a pair with MISS at most.

    A level loses a pair that is further apart than the spill zone is wide and
    has the zone between its two; projections are taken as normal and the split
    as at their median, where most lie.
    """
    bell, apart = NormalDist(), math.sqrt(2 - 2 * COSINE)
    options = []
    for spill in SPILLS:
        beyond = 2 * (bell.pdf(2 * spill) - 2 * spill * bell.cdf(-2 * spill))  # by how much a pair exceeds the zone on average
        both = 2 * bell.cdf(spill * apart) - 1  # the share of vectors that go to both sides
        levels = F.ceil(F.log(size / LEAF) / math.log(2 * SLACK / (1 + both)))
        lost = 1 - F.pow(F.lit(1 - bell.pdf(0) * apart * beyond), levels)
        trees = F.greatest(F.lit(TREES), F.ceil(math.log(MISS) / F.log(lost)))
        options.append(F.struct((trees * F.pow(F.lit(1 + both), levels)).alias("copies"), trees.cast("int").alias("trees"), F.lit(spill).alias("spill")))
    return F.array_min(F.array(*options))


def _options(direction: int) -> "F.Column":
    """The eleven quantiles around the median as splits: how many quantiles lie
    in the spill zone of each, and how far from the median it is."""
    quantiles = F.col(f"q{direction}")

    def option(at, i):
        zone = F.size(F.filter(quantiles, lambda x: F.abs(x - at) <= F.col("margin")))
        return F.struct(zone.alias("zone"), F.abs(i - 5).alias("off"), F.lit(direction).alias("direction"), at.alias("at"))

    return F.transform(F.slice(quantiles, 5, 11), option)


def _leaves(rows: DataFrame) -> DataFrame:
    """(cid, root, node, size) of rows (cid, root, proj, margin): the leaves of each vector.

    root: the tree and what is compared together; margin: half the spill zone.
    """
    state = rows.withColumn("node", F.lit(1).cast("long"))
    done: DataFrame | None = None
    for level in itertools.count():
        these = [(level * CHOICE + k) % DIRECTIONS for k in range(CHOICE)]
        quantiles = [F.percentile_approx(F.col("proj")[d], [k / 20 for k in range(1, 20)], 1000).alias(f"q{d}") for d in these]
        nodes = state.groupBy("root", "node").agg(F.count(F.lit(1)).alias("size"), F.first("margin").alias("margin"), *quantiles)
        options = F.concat(*[_options(d) for d in these])
        cost = F.transform(options, lambda o: F.struct((o["zone"] + o["off"]).alias("cost"), o["zone"].alias("zone"), o["direction"].alias("direction"), o["at"].alias("at")))
        best = F.array_min(F.filter(cost, lambda o: o["zone"] <= ZONE))
        nodes = checkpointed(nodes.select("root", "node", "size", F.when(F.col("size") > LEAF, best).alias("split")))
        few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        told = checkpointed(state.join(F.broadcast(nodes) if few else nodes, ["root", "node"]))
        ended = told.where("split IS NULL").select("cid", "root", "node", "size")
        done = ended if done is None else done.unionByName(ended)
        if nodes.where("split IS NOT NULL").isEmpty():
            return done
        apart = F.get("proj", F.col("split.direction")) - F.col("split.at")
        sides = F.filter(F.array(F.when(apart <= F.col("margin"), F.lit(0)), F.when(apart > -F.col("margin"), F.lit(1))), lambda s: s.isNotNull())
        # the split's own place is to the left, so a vector is in one child at least
        state = told.where("split IS NOT NULL").withColumn("side", F.explode(sides)).select(
            "cid", "root", "proj", "margin", F.xxhash64("node", "side").alias("node"))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, vector, trees, group, margin) of any lengths -> (cid, group, tree, proj, margin), a row for each tree."""
    for batch in batches:
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        for length in np.unique(lengths):
            every = np.flatnonzero(lengths == length)
            for at in range(0, len(every), PROJECTED):
                part = batch.take(pa.array(every[at:at + PROJECTED]))
                trees = part.column(2).to_numpy()
                made = unit(matrix(part.column(1))) @ _directions(int(length), int(trees.max())).T
                has = np.arange(trees.max(), dtype=np.int64) < trees[:, None]
                vector, tree = np.nonzero(has)
                proj = made.astype(np.float32).reshape(*has.shape, DIRECTIONS)[has].reshape(-1)
                ends = np.arange(len(vector) + 1, dtype=np.int32) * DIRECTIONS
                cid, group, margin = (part.column(k).take(pa.array(vector)) for k in (0, 3, 4))
                yield pa.RecordBatch.from_arrays([cid, group, pa.array(tree.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(proj)), margin],
                                                 names=["cid", "group", "tree", "proj", "margin"])


def _near(rows: np.ndarray, single: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the pairs of unit vectors at COSINE or more, each pair once if a is b.

    Single precision finds what may be near, double precision decides.
    """
    slack = max(1e-5, rows.shape[1] * 2.0**-22)
    maybe = single[a] @ single[b].T >= COSINE - slack
    if a is b:
        maybe &= np.triu(np.ones_like(maybe), 1)
    x, y = np.nonzero(maybe)
    if len(x) > maybe.size // 32:
        return np.nonzero(maybe & (rows[a] @ rows[b].T >= COSINE))
    sure = np.einsum("ij,ij->i", rows[a[x]], rows[b[y]]) >= COSINE
    return x[sure], y[sure]


def _earlier(lists: pa.ListArray, leaf: int) -> np.ndarray | None:
    """The names below ``leaf`` among each vector's leaves, padded by a number that meets nowhere; None if there are none."""
    ends = lists.offsets.to_numpy()
    names = lists.flatten().to_numpy() if lists.offset == 0 else lists.values.to_numpy()
    width = int(np.diff(ends).max())
    earlier = np.full((len(lists), width), np.iinfo(np.int64).max)
    for k in range(width):
        has = ends[:-1] + k < ends[1:]
        value = names[ends[:-1][has] + k]
        earlier[np.flatnonzero(has)[value < leaf], k] = value[value < leaf]
    return earlier if (earlier != np.iinfo(np.int64).max).any() else None


def _new(earlier: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share no earlier leaf."""
    new = np.ones(len(x), bool)
    for at in range(0, len(x), 1 << 15):
        i, j = x[at:at + (1 << 15)], y[at:at + (1 << 15)]
        known = np.zeros(len(i), bool)
        for k in range(earlier.shape[1]):
            mine = earlier[i, k]
            known |= (mine != np.iinfo(np.int64).max) & (earlier[j] == mine[:, None]).any(1)
        new[at:at + (1 << 15)] = ~known
    return new


def _star(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges with the same components as the pairs (x, y) of a tile of a and b."""
    at = np.unique(np.concatenate([a, b]))
    near = np.zeros((len(at), len(at)), bool)
    i, j = np.searchsorted(at, x), np.searchsorted(at, y)
    near[i, j] = near[j, i] = True
    i, j = spanning_forest(near)
    return at[i], at[j]


def _compare(table: pa.Table) -> pa.Table:
    """A leaf, or a pair of its blocks: (cid, links) of each vector and (cid, other) edges."""
    leaf, first, second = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
    cid, block = table.column("cid").to_numpy(), table.column("block").to_numpy()
    count = table.column("count").to_numpy()
    rows = unit(matrix(table.column("vector").combine_chunks()))
    single = rows.astype(np.float32)
    earlier = _earlier(table.column("leaves").combine_chunks(), leaf)
    links, top = np.zeros(len(cid), np.int64), np.arange(len(cid))
    low, high = ([at[k:k + TILE] for k in range(0, len(at), TILE)] for at in (np.flatnonzero(block == b) for b in (first, second)))
    if first == second:
        high = low
    for k, a in enumerate(low):
        for b in high[k if first == second else 0:]:
            x, y = _near(rows, single, a, b)
            x, y = a[x], b[y]
            i, j = (x, y) if earlier is None else (c[new] for new in [_new(earlier, x, y)] for c in (x, y))
            for u, v in ((i, j), (j, i)):
                links += np.bincount(u, count[v], len(cid)).astype(np.int64)
            apart = top[x] != top[y]
            x, y = x[apart], y[apart]
            for i, j in zip(*((x, y) if len(x) <= SPARSE else _star(x, y, a, b)), strict=True):
                if top[i] != top[j]:
                    top[top == top[j]] = top[i]
    hit, inner = np.flatnonzero(links), np.flatnonzero(top != np.arange(len(cid)))
    return pa.table({"a": pa.array(np.concatenate([cid[hit], cid[top[inner]]]), pa.int64()),
                     "b": pa.array(np.concatenate([cid[hit], cid[inner]]), pa.int64(), mask=np.arange(len(hit) + len(inner)) < len(hit)),
                     "links": pa.array(np.concatenate([links[hit], np.zeros(len(inner), np.int64)]), pa.int64())})


def _split(deep: DataFrame) -> DataFrame:
    """(cid, vector, count, leaf, size, leaves) of rows (cid, vector, count, label, h3, trees, margin, ...) of the
    labels that are split: a row for each leaf that a vector is in, which carries the names of them all, so that a
    pair is counted in one leaf only."""
    rooted = deep.select("cid", "vector", "trees", F.xxhash64("label", "h3").alias("group"), "margin").mapInArrow(
        _project, "cid long, group long, tree int, proj array<float>, margin double").select(
        "cid", F.xxhash64("group", "tree").alias("root"), "proj", "margin")
    found = checkpointed(_leaves(checkpointed(rooted))
                         .select("cid", F.xxhash64("root", "node").alias("leaf"), "size").distinct())
    lists = found.groupBy("cid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return found.join(lists, "cid").join(deep.select("cid", "vector", "count"), "cid")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of df.

    n_links: how many other rows of the same label have a cosine of at least
    ``COSINE`` with this one; component_id: the smallest id that links reach;
    kept: id = component_id. Vectors that are null, empty or zero or hold null
    or non-finite numbers, and rows with a null label, have no link and are
    their own component. Vectors of different lengths are not linked. Repeated
    rows are rows like any others, linked with each other. Rows with a null id
    take part; they are not kept, unless they have no link and only null ids
    to reach, where component_id is null too. Other columns are not read.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    own = own.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    # 96 bits of the numbers name a vector within its label
    key = ["label", "h1", "h2", "h3"]
    own = own.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector")).withColumn("h3", F.size("vector"))
    classes = own.where("ok").groupBy(*key).agg(F.any_value("vector").alias("vector"), F.min("id").alias("first"), F.count(F.lit(1)).alias("count"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))  # written once, so the numbers stay
    # labels, those that are split with their trees
    sizes = classes.groupBy("label", "h3").agg(F.count(F.lit(1)).alias("size")).withColumn("plan", _plan(F.col("size")))
    cheap = (F.col("size") > LEAF) & (F.col("plan.copies") * WHOLE * LEAF < F.col("size"))
    margin = math.sqrt(2 - 2 * COSINE) * F.col("plan.spill") / F.sqrt("h3")
    labels = checkpointed(sizes.select("label", "h3", "size", F.when(cheap, F.col("plan.trees")).alias("trees"), F.when(cheap, margin).alias("margin")))
    sized = look_up(classes.select("cid", "vector", "count", "label", "h3"), labels, ["label", "h3"])
    placed = sized.where("trees IS NULL AND size > 1").withColumn("leaf", F.xxhash64("label", "h3")).select(
        "cid", "vector", "count", "leaf", "size", F.array("leaf").alias("leaves"))
    if not labels.where("trees IS NOT NULL").isEmpty():
        placed = placed.unionByName(_split(sized.where("trees IS NOT NULL")))
    blocks = F.greatest(F.ceil(F.col("size") * F.greatest(F.size("vector"), F.lit(SHORT)) / (BLOCK * SHORT)), F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    placed = placed.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "count", "vector", "leaves")
    out = checkpointed(placed.groupBy("leaf", "low", "high").applyInArrow(_compare, "a long, b long, links long"))
    links = out.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    components = connected_components(out.where("b IS NOT NULL").select("a", "b"))
    named = checkpointed(components.join(classes.select(F.col("cid").alias("node"), "first"), "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_first"))
    reached = look_up(named, checkpointed(firsts), "component").select(F.col("node").alias("cid"), "component_first")
    told = classes.select(*key, "cid", "first", "count").join(links, "cid", "left").join(reached, "cid", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component_first", "first").alias("component_id"))
    columns = [F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")]
    linked = look_up(own.where("ok").select("id", *key), checkpointed(told), key).select(*columns)
    alone = own.where("NOT ok").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("id")).select(
        *columns[:3], F.col("id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
