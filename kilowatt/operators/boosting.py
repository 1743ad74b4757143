"""Leaf-wise gradient boosting of many fits in one pass (EST3, EST4, TUN2).

A fit is a setting and a fold: it learns from the rows of the other folds, or
from all rows. All fits grow their trees at the same time: one Spark job
serves one level of every fit's current tree.

- Values become bins once (at most ``max_bins`` a slot); rows are blocks of bins.
- A task walks its rows through the trees so far and adds up a histogram
  (leaf, slot, bin) of counts and residuals for the open leaves of its fits;
  histograms of row blocks are summed by a shuffle, and the best split of each
  leaf is chosen there. The driver gets one row a leaf, never a histogram.
- Leaf-wise growth with a budget of L leaves splits the leaf with the largest
  gain first. A leaf's gain does not depend on what else was split, so levels
  can be grown for all open leaves together and the order be played through
  afterwards. A leaf is opened only while its bottleneck (the least gain on the way
  to it) is among the L - 1 largest known: any other is never reached.
- Where all rows are one block, as with one hourly series, nothing is to be
  summed between tasks: the groups of fits are the tasks, and each runs the same rounds
  on its own.
- Residuals are kept with the rows; every ``CHECKPOINT`` rounds they go to the
  shared checkpoint folder, so a lost executor costs a few rounds.

Models come back as node tables; see :mod:`kilowatt.operators.trees`.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilowatt.session import ensure_checkpoint_dir

#: Bytes of residuals in a block of rows, and bytes of histograms summed at once.
BLOCK_BYTES = 16 << 20
#: Fits are dealt to so many groups, each a task of its own on every block of rows.
GROUPS = 8
CHECKPOINT = 25
#: Trees are stored by position, so their depth is bounded.
DEEPEST = 12
MOST_BINS = 64


@dataclass(frozen=True)
class Setting:
    """start "mean": from the mean label, each tree added times ``learning_rate``
    (leaf-wise boosting's habit). start "tree": the first tree is added whole, the others
    fit the squared loss's gradient, twice the residual (MLlib's habit)."""

    max_depth: int = 5
    num_leaves: int | None = None
    learning_rate: float = 0.1
    rounds: int = 100
    min_rows: int = 1
    start: str = "mean"

    def rate(self, t: int) -> float:
        if self.start == "mean":
            return self.learning_rate
        return 2 * self.learning_rate if t else 1.0


@dataclass(frozen=True)
class Slot:
    """A feature's bins: ``edges`` (a value up to edges[b] is in bin b or before), or
    the sorted ``categories``, one bin each; another value is in a last bin."""

    name: str
    edges: tuple[float, ...] = ()
    categories: tuple[float, ...] = ()

    def bins(self, values: np.ndarray) -> np.ndarray:
        if not self.categories:
            return np.searchsorted(np.array(self.edges), values, "left").astype(np.uint8)
        known = np.array(self.categories)
        at = np.searchsorted(known, values)
        return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == values), at, len(known)).astype(np.uint8)


def find_slots(df: DataFrame, features: Sequence[str], max_bins: int = 32, max_categories: int = 0) -> list[Slot]:
    """Bins of each column: its distinct values where these are at most
    ``max_bins`` (edges half-way), else approximate quantiles. A column of at
    most ``max_categories`` distinct values is categorical. What reaches the
    driver is max_bins + 1 values a column."""
    if not 2 <= max_bins <= MOST_BINS:
        raise ValueError(f"max_bins must be 2 to {MOST_BINS}")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col(c).cast("double").alias("value")) for k, c in enumerate(features)])).alias("s"))
    distinct = each.select("s.slot", "s.value").where("value IS NOT NULL AND NOT isnan(value)").distinct()
    some = distinct.withColumn("k", F.row_number().over(W.partitionBy("slot").orderBy("value"))).where(F.col("k") <= max_bins + 1).collect()
    found: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for row in some:
        found[row["slot"]].append(row["value"])
    wide = [k for k, values in found.items() if len(values) > max_bins]
    shares = [b / max_bins for b in range(1, max_bins)]
    cuts = df.agg(*[F.percentile_approx(F.col(features[k]).cast("double"), shares, 10_000).alias(str(k)) for k in wide]).first() if wide else {}
    slots = []
    for k, name in enumerate(features):
        values = sorted(found[k])
        if k in wide:
            slots.append(Slot(name, edges=tuple(sorted(set(cuts[str(k)])))))
        elif len(values) <= max_categories:
            slots.append(Slot(name, categories=tuple(values)))
        else:
            slots.append(Slot(name, edges=tuple((a + b) / 2 for a, b in zip(values, values[1:], strict=False))))
    return slots


def _blocks(df: DataFrame, slots: list[Slot], label: str, fold_col: str | None, fits: int) -> RDD:
    """((block, group), (bins, label, fold)) of the rows, each group of fits with a copy of the bins."""
    rows = max(256, BLOCK_BYTES // (8 * max(1, -(-fits // GROUPS))))
    cols = [F.col(s.name).cast("double").alias(f"x{k}") for k, s in enumerate(slots)]
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
    whole = df.select(*cols, F.col(label).cast("double").alias("y"), fold.alias("fold")).dropna()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            value = [table.column(k).to_numpy() for k in range(table.num_columns)]
            packed = np.stack([s.bins(v) for s, v in zip(slots, value, strict=False)], axis=1), value[-2], value[-1].astype(np.int16)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(packed)], pa.binary())], names=["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(b.num_rows for b in held) >= rows:
                    yield out()
                    held = []
        if held:
            yield out()

    numbered = whole.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).zipWithIndex().persist(StorageLevel.MEMORY_AND_DISK)
    blocks = numbered.count()
    groups = min(GROUPS, fits)
    dealt = numbered.flatMap(lambda b: [((b[1], g), b[0]) for g in range(groups)])
    return dealt.partitionBy(max(1, blocks * groups), lambda key: key[0] * groups + key[1])


class _Trees:
    """The current tree of each of some fits, by position: node k has children 2k and 2k + 1."""

    def __init__(self, slot: np.ndarray, left: np.ndarray):
        self.slot, self.left = slot, left  # slot -1: a leaf; left: the bins that go left, as bits

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node each row is in, a row for each fit."""
        fits, size = self.slot.shape
        node = np.ones((fits, len(bins)), np.int64)
        fit, row = np.arange(fits)[:, None], np.arange(len(bins))[None, :]
        while True:
            inside = np.minimum(node, size - 1)
            slot = np.where(node < size, self.slot[fit, inside], -1)
            if (slot < 0).all():
                return node
            bit = (self.left[fit, inside] >> bins[row, np.maximum(slot, 0)].astype(np.uint64)) & np.uint64(1)
            node = np.where(slot >= 0, 2 * node + 1 - bit.astype(np.int64), node)


def _histogram(data: tuple, trees: _Trees, place: np.ndarray, held: np.ndarray, n_slots: int, n_bins: int) -> np.ndarray:
    """(leaf, slot, bin, count and residuals) of a block's rows; place: the number of
    each fit's open leaves, -1 elsewhere; rows of a fit's own fold do not count."""
    bins, y, fold, score = data
    leaves, size = int(place.max()) + 1, place.shape[1]
    node = trees.walk(bins)
    at = np.where(node < size, place[np.arange(len(node))[:, None], np.minimum(node, size - 1)], -1)
    use = (at >= 0) & (fold[None, :] != held[:, None])
    row = np.nonzero(use)[1]
    leaf, residual = at[use] * n_bins, (y[None, :] - score)[use]
    out = np.zeros((leaves, n_slots, n_bins, 2))
    for k in range(n_slots):
        cell = leaf + bins[row, k]
        out[:, k, :, 0] = np.bincount(cell, minlength=leaves * n_bins).reshape(leaves, n_bins)
        out[:, k, :, 1] = np.bincount(cell, residual, leaves * n_bins).reshape(leaves, n_bins)
    return out


def _best(h: np.ndarray, least: np.ndarray, categorical: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each leaf of a histogram; ties: the first slot, the lowest
    edge. Categories are put in order of their mean residual first."""
    leaves, n_slots, n_bins, _ = h.shape
    order = np.broadcast_to(np.arange(n_bins), h.shape[:3]).copy()
    if categorical.any():
        mean = np.where(h[..., 0] > 0, h[..., 1] / np.maximum(h[..., 0], 1), np.inf)
        order[:, categorical] = np.argsort(mean[:, categorical], axis=2, kind="stable")
    run = np.cumsum(np.take_along_axis(h, order[..., None], 2), axis=2)
    n, s = run[:, :, -1:, 0], run[:, :, -1:, 1]
    nl, sl = run[:, :, :-1, 0], run[:, :, :-1, 1]
    nr, sr = n - nl, s - sl
    gain = sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - s**2 / np.maximum(n, 1)
    enough = least[:, None, None]
    gain = np.where((nl >= enough) & (nr >= enough), gain, -np.inf).reshape(leaves, -1)
    best = gain.argmax(1)
    rows, slot, cut = np.arange(leaves), best // (n_bins - 1), best % (n_bins - 1)
    taken = np.arange(n_bins)[None, :] <= cut[:, None]
    bits = np.where(taken, np.uint64(1) << order[rows, slot].astype(np.uint64), np.uint64(0))
    pick = lambda x: x.reshape(leaves, -1)[rows, best]
    return {"n": n[:, 0, 0], "s": s[:, 0, 0], "slot": slot, "left": np.bitwise_or.reduce(bits, axis=1), "gain": gain[rows, best],
            "nl": pick(nl), "sl": pick(sl), "nr": pick(nr), "sr": pick(sr)}


class _Growing:
    """A fit's tree while it grows: node -> (n, s), and node -> split."""

    def __init__(self, setting: Setting):
        self.setting = setting
        self.sums: dict[int, tuple[float, float]] = {}
        self.splits: dict[int, tuple[float, int, int]] = {}  # gain, slot, left
        self.narrow: dict[int, float] = {}  # the least gain on the way to a split, its own included
        self.open = [1]

    def add(self, node: int, n: float, s: float, gain: float, slot: int, left: int, nl: float, sl: float, nr: float, sr: float) -> None:
        self.sums[node] = n, s
        if gain > 1e-10 * (1 + s * s / max(n, 1)):
            self.splits[node] = gain, slot, left
            self.narrow[node] = min(gain, self.narrow.get(node // 2, np.inf))
            self.sums[2 * node], self.sums[2 * node + 1] = (nl, sl), (nr, sr)

    def deepen(self) -> None:
        """The leaves to open next."""
        budget = self.setting.num_leaves
        least = -np.inf
        if budget and len(self.narrow) >= budget:
            least = sorted(self.narrow.values(), reverse=True)[max(0, budget - 2)]
        split = [node for node in self.open if node in self.splits and self.narrow[node] >= least]
        children = [c for node in split for c in (2 * node, 2 * node + 1)]
        self.open = [c for c in children if c.bit_length() <= self.setting.max_depth and self.sums[c][0] >= 2 * self.setting.min_rows]

    def finish(self) -> None:
        """Splits in the order of their gains, up to the leaf budget."""
        left, kept = (self.setting.num_leaves or 1 << 30) - 1, {}
        queue = [(-self.splits[1][0], 1)] if 1 in self.splits else []
        while queue and left:
            _, node = heapq.heappop(queue)
            kept[node] = self.splits[node]
            left -= 1
            for child in (2 * node, 2 * node + 1):
                if child in self.splits:
                    heapq.heappush(queue, (-self.splits[child][0], child))
        self.splits = kept


@dataclass
class Fits:
    """Fitted ensembles: the nodes of the fits on all rows, and each fit's sums over the rows it held out."""

    slots: list[Slot]
    fits: list[tuple[Setting, int | None]]
    start: list[float]
    nodes: list[tuple]
    held: dict[int, tuple[float, float, float, float, float]]

    def metrics(self) -> list[tuple[Setting, int, dict[str, float]]]:
        """(setting, fold, rmse, mse, mae, r2) of each fit with a fold, over the rows of that fold."""
        out = []
        for k, (setting, fold) in enumerate(self.fits):
            if fold is not None and self.held.get(k, (0,))[0]:
                n, se, ae, y, yy = self.held[k]
                out.append((setting, fold, {"rmse": (se / n) ** 0.5, "mse": se / n, "mae": ae / n, "r2": 1 - se / (yy - y * y / n) if yy - y * y / n else float("nan")}))
        return out

    def of(self, setting: Setting) -> tuple[float, list[tuple]]:
        """(start, nodes) of a setting's fit on all rows; a node is (tree, node, slot, threshold,
        categories, left, right, value, gain, n), a value to be added as it is."""
        k = self.fits.index((setting, None))
        return self.start[k], [row[1:] for row in self.nodes if row[0] == k]


def fit_many(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[Setting], folds: int = 0, fold_col: str | None = None,
             max_bins: int = 32, max_categories: int = 0, slots: list[Slot] | None = None) -> Fits:
    """Every setting fitted on all rows and, with ``folds``, on the rows of all folds but each.

    Rows with a null or NaN label, feature or fold are left out. No rows:
    ensembles without trees that predict 0. A model
    depends on the rows, their blocks and the settings alone.
    """
    if any(not 1 <= s.max_depth <= DEEPEST for s in settings):
        raise ValueError(f"max_depth must be 1 to {DEEPEST}")
    ensure_checkpoint_dir(df.sparkSession)
    slots = slots or find_slots(df, features, max_bins, max_categories)
    fits = [(s, k) for s in settings for k in [None, *range(folds)]]
    groups = min(GROUPS, len(fits))
    member = [list(range(g, len(fits), groups)) for g in range(groups)]
    held = [np.array([-2 if fits[k][1] is None else fits[k][1] for k in m]) for m in member]
    categorical = np.array([bool(s.categories) for s in slots])
    n_bins = max(2, *[len(s.categories) + 1 if s.categories else len(s.edges) + 1 for s in slots])
    blocks = _blocks(df, slots, label, fold_col, len(fits)).persist(StorageLevel.MEMORY_AND_DISK)
    sums = {f: (n, s) for f, n, s in blocks.filter(lambda b: b[0][1] == 0).flatMap(
        lambda b: [(int(f), int((b[1][2] == f).sum()), float(b[1][1][b[1][2] == f].sum())) for f in np.unique(b[1][2])]).map(
        lambda r: (r[0], r[1:])).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).map(lambda r: (r[0], *r[1])).collect()}
    start = []
    for setting, fold in fits:  # a training set is all rows less its fold
        n, s = (sum(v[i] for f, v in sums.items() if f != fold) for i in (0, 1))
        start.append(s / n if n and setting.start == "mean" else 0.0)

    def begun(b):
        (at, g), (bins, y, fold) = b
        return (at, g), (bins, y, fold, np.repeat(np.array([start[k] for k in member[g]])[:, None], len(y), 1))

    def histograms(g, data, trees, place):
        return _histogram(data, trees, place, held[g], len(slots), n_bins)

    def errors(g, data):
        _, y, fold, score = data
        for i, k in enumerate(member[g]):
            mine = fold == held[g][i]
            if mine.any():
                apart, own = y[mine] - score[i, mine], y[mine]
                yield k, np.array([mine.sum(), (apart**2).sum(), np.abs(apart).sum(), own.sum(), (own**2).sum()])

    if not sums:
        nodes, found = [], {}
    elif blocks.getNumPartitions() <= groups:
        # one block of rows: a task has all rows of its fits and grows their trees without waiting for others
        def whole(b):
            (_, g), data = begun(b)
            now = [data]

            def best_of(trees, place, enough):
                return [_best(histograms(g, now[0], trees[0], place[0]), enough[0], categorical)]

            def step(trees, value):
                now[0] = _stepped(now[0], trees[0], value[0])

            nodes = _boost(fits, [member[g]], slots, best_of, step)
            return nodes, list(errors(g, now[0]))

        parts = blocks.map(whole).collect()
        nodes, found = [row for p in parts for row in p[0]], dict(e for p in parts for e in p[1])
    else:
        state = blocks.map(begun, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        kept: list[RDD] = [state]  # the rows with their residuals; before them the ones they come from, until they are computed

        def best_of(trees, place, enough):
            def own(b):
                total: dict[int, np.ndarray] = {}
                for (_, g), data in b:
                    if (place[g] >= 0).any():
                        h = histograms(g, data, trees[g], place[g])
                        total[g] = total[g] + h if g in total else h
                return iter(total.items())

            parts = kept[-1].mapPartitions(own).reduceByKey(lambda a, b: a + b, groups)
            best = dict(parts.map(lambda p: (p[0], _best(p[1], enough[p[0]], categorical))).collect())
            while len(kept) > 1:
                kept.pop(0).unpersist()
            return [best.get(g) for g in range(groups)]

        def step(trees, value):
            new = kept[-1].map(lambda b: (b[0], _stepped(b[1], trees[b[0][1]], value[b[0][1]])), preservesPartitioning=True)
            new.persist(StorageLevel.MEMORY_AND_DISK)
            step.rounds += 1
            if step.rounds % CHECKPOINT == 0:
                new.checkpoint()
            kept.append(new)

        step.rounds = 0
        nodes = _boost(fits, member, slots, best_of, step)
        found = dict(kept[-1].flatMap(lambda b: errors(b[0][1], b[1])).reduceByKey(lambda a, b: a + b).collect())
        for rdd in kept:
            rdd.unpersist()
    blocks.unpersist()
    return Fits(slots, fits, start, nodes, {k: tuple(v.tolist()) for k, v in found.items()})


def _stepped(data: tuple, trees: _Trees, value: np.ndarray) -> tuple:
    """Rows with the values of their leaves added."""
    bins, y, fold, score = data
    node = trees.walk(bins)
    return bins, y, fold, score + value[np.arange(len(node))[:, None], node]


def _boost(fits: list, member: list[list[int]], slots: list[Slot], best_of: Callable, step: Callable) -> list[tuple]:
    """The rounds of the fits of ``member``, a list for each group: best_of(trees,
    open leaves, least rows) has the best splits of the open leaves, step(trees, values) adds
    finished trees. The nodes of the fits on all rows are returned."""
    nodes: list[tuple] = []
    for t in range(max(fits[k][0].rounds for m in member for k in m)):
        growing = {k: _Growing(fits[k][0]) for m in member for k in m if t < fits[k][0].rounds}
        size = 1
        while any(tree.open for tree in growing.values()):
            slot = [np.full((len(m), size), -1, np.int16) for m in member]
            left = [np.zeros((len(m), size), np.uint64) for m in member]
            place = [np.full((len(m), 2 * size), -1, np.int32) for m in member]
            where: list[list[tuple[int, int]]] = [[] for _ in member]
            for g, m in enumerate(member):
                for i, k in enumerate(m):
                    tree = growing.get(k)
                    if tree and tree.open:
                        for node, (_, at, bits) in tree.splits.items():
                            slot[g][i, node], left[g][i, node] = at, bits
                        for node in tree.open:
                            place[g][i, node] = len(where[g])
                            where[g].append((k, node))
            trees = [_Trees(a, b) for a, b in zip(slot, left, strict=True)]
            enough = [np.array([fits[k][0].min_rows for k, _ in w]) for w in where]
            for g, found in enumerate(best_of(trees, place, enough)):
                if found is not None:
                    columns = [found[c].tolist() for c in ("n", "s", "gain", "slot", "left", "nl", "sl", "nr", "sr")]
                    for (k, node), row in zip(where[g], zip(*columns, strict=True), strict=True):
                        growing[k].add(node, *row)
            for tree in growing.values():
                tree.deepen()
            size *= 2
        slot, left, value = [], [], []
        for m in member:
            for k in m:
                if k in growing:
                    growing[k].finish()
            size = 1 << max([1, *[max(growing[k].splits, default=0).bit_length() for k in m if k in growing]])
            slot.append(np.full((len(m), size), -1, np.int16))
            left.append(np.zeros((len(m), size), np.uint64))
            value.append(np.zeros((len(m), 2 * size)))
            for i, k in enumerate(m):
                if k not in growing:
                    continue
                tree, (setting, fold) = growing[k], fits[k]
                for node in sorted({1, *[c for node in tree.splits for c in (2 * node, 2 * node + 1)]} & set(tree.sums)):
                    n, s = tree.sums[node]
                    mean = setting.rate(t) * s / n if n else 0.0
                    inner = tree.splits.get(node)
                    if inner:
                        slot[-1][i, node], left[-1][i, node] = inner[1:]
                    else:
                        value[-1][i, node] = mean
                    if fold is None:
                        nodes.append((k, t, node, *_split(slots, inner), *((2 * node, 2 * node + 1) if inner else (None, None)), mean, inner[0] if inner else None, int(n)))
        step([_Trees(a, b) for a, b in zip(slot, left, strict=True)], value)
    return nodes


def _split(slots: list[Slot], inner: tuple[float, int, int] | None) -> tuple:
    """(slot, threshold, categories) of a split."""
    if not inner:
        return None, None, None
    _, at, bits = inner
    if slots[at].categories:
        return at, None, [c for b, c in enumerate(slots[at].categories) if bits >> b & 1]
    return at, slots[at].edges[bits.bit_length() - 1], None
