"""Packing: sum-of-squares online packing into fixed windows.

``pack`` tokenizes every document, cuts off its full windows and places the
rest, document by document, into partly filled windows. The place of a rest
is the fill level (or a new window) after which the sum of the squared counts
of partly filled windows over all levels is least; the counts are a level
array of ``window`` + 1 numbers, so a document is placed by one vector
expression, whatever the number of open windows.

Each task packs the documents of its own split: nothing is shuffled, and open
windows never meet in one place. What is still open at a split's end is
joined by cutting: the fullest windows are filled up with pieces of the
others, and the last one is split into sequences of power-of-two lengths,
which need no padding. Per split at most that one window is cut so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilowatt.llm import bpe, flat

WINDOW = 1024


class SquaresPacker:
    """Open windows by fill level, and the choice of a level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, size: int, item: object) -> list | None:
        """Put an item of 0 < size < window; the window's items if it is full now.

        Level h > 0 takes it to h + size: the squares change by
        2 count[h + size] + 1 - (2 count[h] - 1), or by the second part alone
        if the window is then full; a new window by 2 count[size] + 1. Ties:
        the fullest level, an old window before a new one.
        """
        w, n = self.window, self.count
        room = w - size
        change = 2 - 2 * n[1:room + 1]
        change[:-1] += 2 * n[1 + size:w]
        change[-1] -= 1  # the window is full and leaves the counts
        cost = np.where(n[1:room + 1] > 0, change, 1 << 40)
        best = room - 1 - int(np.argmin(cost[::-1]))
        if cost[best] > 2 * n[size] + 1:
            level, items = 0, []
        else:
            level = best + 1
            items = self.open[level].pop()
            n[level] -= 1
        items.append(item)
        level += size
        if level == w:
            return items
        self.open[level].append(items)
        n[level] += 1
        return None

    def rest(self) -> list[list]:
        """The open windows, the fullest first; none is open afterwards."""
        out = [items for level in reversed(self.open) for items in level]
        self.__init__(self.window)
        return out


def _powers(length: int) -> list[int]:
    """Powers of two that sum to length, the largest first."""
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


def closing(windows: list[list], window: int) -> Iterator[list]:
    """Sequences of the windows still open: pieces (document, start, ids) of
    the later ones fill the earlier ones; the last is cut at powers of two."""
    pieces = [p for items in windows for p in items]
    total = sum(len(p[2]) for p in pieces)
    sizes = [window] * (total // window) + _powers(total % window)
    it = iter(pieces)
    piece = next(it, None)
    for size in sizes:
        out, left = [], size
        while left:
            doc, start, ids = piece
            take = min(left, len(ids))
            out.append((doc, start, ids[:take]))
            left -= take
            piece = (doc, start + take, ids[take:]) if take < len(ids) else next(it, None)
        yield out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces (id_col, start, length, ids binary, doc_tokens, sequence_id, offset).

    A document is its token ids and then ``end_id``; null or empty text is
    ``end_id`` alone, so every row has a piece. start: how many of the row's
    ids come before the piece; ids: its token ids as little-endian unsigned
    32-bit integers; offset: where it begins in its sequence. sequence_id is
    the task's number times 2**33 plus a running number: rows with the same or
    a null id are packed like any others. Other columns are not read. An empty
    table gives no pieces.
    """
    path = path or bpe.default_path()
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = bpe.load(path), SquaresPacker(window)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        rows: list[tuple] = []

        def put(items: list) -> None:
            nonlocal sequence
            offset = 0
            for (key, n), start, ids in items:
                rows.append((key, start, len(ids), ids.tobytes(), n, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, ARROW, strict=True)], names=NAMES)

        ARROW: list[pa.DataType] = []
        for batch in batches:
            ARROW = ARROW or [batch.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for row, texts in flat.chunks(batch.column(1)):
                keys = batch.column(0).slice(row, len(texts)).to_pylist()
                ids, ends = encoder.encode_flat(*flat.utf8(texts))
                ids = ids.astype("<u4")
                for key, a, b in zip(keys, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n = b - a + 1
                    owner = (key, n)
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    whole = n - n % window
                    for start in range(0, whole, window):
                        put([(owner, start, own[start:start + window])])
                    if n > whole and (full := packer.place(n - whole, (owner, whole, own[whole:].copy()))):
                        put(full)
                yield flush()
        for items in closing(packer.rest(), window):
            put(items)
        if rows:
            yield flush()

    NAMES = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(NAMES, [
        kind, T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType()], strict=True)])
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row (sequences, tokens, padding): what padding to ``window`` adds,
    sequences whose length is a power of two left as they are."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return own.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
                   F.coalesce(F.sum(F.when(power, 0).otherwise(window - F.col("n"))), F.lit(0)).alias("padding"))
