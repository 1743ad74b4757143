"""Flat arrays over many texts: one byte buffer, spans of words, span hashes.

The operators that read whole texts take an Arrow string column, lay its
UTF-8 bytes out as one numpy buffer and work on positions of that buffer, a
bounded chunk of texts at a time. A text longer than the chunk bound is a
chunk of its own; what counts words or n-grams takes it in pieces and adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (arrays of 8 bytes a position are kept).
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive rows with up to max_bytes of text;
    null is taken as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + max_bytes, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, column.slice(row, stop - row)
        row = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as one buffer, and the offsets of each text in it."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def pieces(texts: pa.Array, words: int = 0) -> Iterator[pa.Array]:
    """The single text of ``texts`` in parts of about CHUNK_BYTES that end at a blank or
    a control, each followed by the ``words`` (alphanumeric) words after it. A text without
    blanks is one part."""
    raw, offsets = utf8(texts)
    n, at = len(raw), 0

    def reach(start: int, enough, step: int) -> int:
        """Where what ``enough`` looks for ends, seen from start in growing windows; or n."""
        while True:
            found = enough(raw[start:start + step])
            if found is not None:
                return start + found
            if start + step >= n:
                return n
            step *= 4

    def blank(part: np.ndarray) -> int | None:
        first = np.flatnonzero(part <= 32)[:1]
        return int(first[0]) if len(first) else None

    def after(part: np.ndarray) -> int | None:
        ends = alphanumeric_spans(part, np.array([0, len(part)]))[1]
        # a last word may go on behind the window
        return int(ends[words - 1]) if len(ends) > words else None

    while at < n:
        end = reach(at + CHUNK_BYTES, blank, 1 << 12) if at + CHUNK_BYTES < n else n
        last = reach(end, after, 1 << 12) if words else end
        yield pa.array([raw[at:last].tobytes()], pa.large_binary()).cast(pa.large_string())
        at = end


def add_up(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum of its counts) of parts (key, count), sorted by key; parts gather until they are as many as what is summed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def merge() -> None:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        every, place = np.unique(keys, return_inverse=True)
        held[:] = [(every, np.bincount(place, counts, len(every)).astype(counts.dtype))]

    for part in parts:
        held.append(part)
        waiting += len(part[0])
        if waiting > max(len(held[0][0]), CHUNK_BYTES):
            merge()
            waiting = 0
    merge()
    return held[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the runs of ``inside``; a run ends with its text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs of bytes other than ASCII white space and controls."""
    return spans(raw > 32, offsets)


#: Letters, digits and bytes of other scripts; all else parts words.
_INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def alphanumeric_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs of letters and digits, without ASCII signs."""
    return spans(_INSIDE[raw], offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply): spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial modulo 2**64
    read off one running sum over the buffer, then mixed with the length."""
    n = len(raw)
    up, down = _power_tables(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[np.minimum(starts, max(n - 1, 0))]
    return mix(h ^ ((ends - starts).astype(np.uint64) << _U(40)))


def gather_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the spans (start, length), one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values[offsets[i]:offsets[i + 1]] as row i of a binary column."""
    values = np.ascontiguousarray(values)
    ends = np.ascontiguousarray(offsets * values.itemsize, dtype=np.int64)
    large = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])
    return large.cast(pa.binary())
