"""Frequent itemsets and association rules (DAT3) with ``FPGrowth``.

FP-growth builds conditional trees per item group on executors (PFP), so
no basket list is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """(items): the distinct items of each key, nulls left out, one row per key.

    The rows ``collect_set`` gives, without an object per key and row: rows are
    shuffled on the key and sorted, and runs of a key are cut from Arrow batches.
    A key without an item is an empty basket, rows without a key are one basket.
    """
    rows = df.select(F.col(key).alias("key"), F.col(item).alias("item"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "item").mapInArrow(_baskets, f"items array<{kind}>")


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Baskets of rows (key, item) that are sorted; the last key's rows wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = _codes(batch.column(0))
        starts = np.flatnonzero(code[1:] != code[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            starts = np.append(0, starts)
        if len(starts):
            yield _gathered([*held, batch.slice(0, starts[-1])])
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield _gathered(held)


def _gathered(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    key, item = (rows.column(i).combine_chunks() for i in (0, 1))
    first, code = np.ones(len(key), bool), _codes(key)
    first[1:] = code[1:] != code[:-1]
    code, keep = _codes(item), item.is_valid().to_numpy(zero_copy_only=False)
    keep[1:] &= first[1:] | (code[1:] != code[:-1])
    ends = np.append(np.append(0, np.cumsum(keep))[np.flatnonzero(first)], keep.sum()).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), item.filter(pa.array(keep)))], names=["items"])


def frequent_itemsets(
    df: DataFrame, items: str = "items", min_support: float = 0.01, min_confidence: float = 0.5, distinct: bool = False
) -> FPGrowthModel:
    """Fit FP-growth; items of a basket are made distinct, unless they are
    (``distinct``): then ``df`` is fitted as it is, and if it is persisted the fit
    keeps no copy of its own."""
    data = df if distinct else df.select(F.array_distinct(F.col(items)).alias(items))
    return FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence).fit(data)
