"""Partitioning helpers. None of them looks at cores, memory or file sizes to
decide what a result is: partition counts are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions of a training set, at least; and rows of one of them.
TRAIN_PARTITIONS = 8
TRAIN_ROWS = 1_000_000


def spread_scan(df: DataFrame, partitions: int = 32) -> DataFrame:
    """Deal the rows of a scan of a few tasks out evenly.

    A table stored as one row group is read by one task, and everything up to
    the first shuffle then runs there. A scan that has ``partitions`` / 4 tasks
    or more is left as it is, so a large table is not shuffled. Only for
    plans whose result does not depend on where a row is; training sets go
    through :func:`by_key`.
    """
    return df.repartition(partitions) if df.rdd.getNumPartitions() * 4 < partitions else df


def train_partitions(df: DataFrame, rows: int = TRAIN_ROWS) -> int:
    """How many partitions a training set needs, by its number of rows alone:
    the same rows give the same layout, and a larger set goes through more tasks."""
    return max(TRAIN_PARTITIONS, -(-df.count() // rows))


def by_key(df: DataFrame, keys: Sequence[str], partitions: int = TRAIN_PARTITIONS) -> DataFrame:
    """A training set's fixed layout: rows placed by the hash of their keys in
    ``partitions`` partitions, each sorted by the keys.

    Samples that a learner draws from partitions (bootstraps, split candidates)
    then depend on the rows alone, not on files, cores or earlier steps. The
    keys should name a row; rows that share them are told apart by the other
    columns' hash.
    """
    others = [c for c in df.columns if c not in keys]
    tie = [F.xxhash64(*[F.col(c).cast("string") for c in others])] if others else []
    return df.repartition(int(partitions), *keys).sortWithinPartitions(*keys, *tie)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a reliable checkpoint (shared folder).

    The data is persisted first so the checkpoint write reads it back
    instead of recomputing the plan; the cache is dropped afterwards. Later
    reads (a row count, a join) then cost a file scan, and the lineage
    behind it is cut.
    """
    from kilowatt.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
