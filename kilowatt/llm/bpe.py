"""Byte-level BPE: batched numpy merge rounds over the words of many texts.

``encode`` and ``decode`` are DataFrame operators. Within a task a chunk of
texts is one flat array: code points are classed by a table, token
boundaries of the pre-tokenizer's pattern come from comparisons of
neighbours, equal words are found by a hash, and the distinct words go
through merge rounds together. A round finds the lowest rank of every word
(pairs are looked up by binary search over the sorted pair keys), merges all
its places at once and looks up only the pairs that changed.

Equal hashes are not trusted: the ids are turned back into bytes and compared
with the text; a chunk that differs is encoded again word by word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilowatt.llm import flat

#: A rank above every merge's.
_NONE = np.int64(1 << 40)
#: Words whose ids a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 1 << 18

LETTER, NUMBER, SPACE = 1, 2, 3


def default_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # Unicode's White_Space property
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                      (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[low:high + 1] = SPACE
    return table


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def token_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions at which a token of the pre-tokenizer begins.

    points: code points of the texts, one after another; edges: where the
    texts begin, with the end appended. The rules are those of the pattern
    contraction | space? letters | space? numbers | space? others | white
    space before a space that joins the next token | white space.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[edges] = True
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= head[:n]
    space = kind == SPACE
    blank = points == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~head[1:n]
    start = run & (space | ~after_blank)
    # the last white space before a word is a token's begin of its own
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= ends_run
    # contractions
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        quote = quote[(quote + 1 < n)]
        quote = quote[~head[quote + 1] & (kind[quote + 1] == LETTER)]
        first = points[quote + 1]
        one = quote[np.isin(first, [ord(c) for c in "stmd"])]
        room = quote[quote + 2 < n]
        room = room[~head[room + 2]]
        a, b = points[room + 1], points[room + 2]
        two = room[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        start[np.concatenate([one, two]) + 1] = False
        for found, size in ((one, 2), (two, 3)):
            after = found + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class ByteBpe:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = _byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        keys, made = [], []
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocab[left] << 20 | vocab[right])
            made.append(vocab[left + right])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        # the first round's pairs are pairs of bytes: their ranks, looked up once
        two = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.byte_rank = self._rank(*two)
        self._reset()

    def _reset(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._known_at = np.zeros(0, np.int64)
        self._known_len = np.zeros(0, np.int64)
        self._known_ids = np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search over the sorted pair keys."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose bytes lie one after another in ``data``;
        (ids, number of ids of each word)."""
        words = len(lengths)
        counts = lengths.astype(np.int64)
        done_ids, done_word = [], []
        sym = self.byte_id[data]
        size = counts.copy()
        name = np.arange(words)
        if words:
            keep = size > 0
            name, size = name[keep], size[keep]
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = self.byte_rank[(data[:-1].astype(np.int64) << 8) | data[1:]]
        if len(size):
            rank[np.cumsum(size) - 1] = _NONE
        while len(size):
            begin = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, begin)
            ended = low == _NONE
            if ended.any():
                gone = np.repeat(ended, size)
                done_ids.append(sym[gone])
                done_word.append(np.repeat(name[ended], size[ended]))
                counts[name[ended]] = size[ended]
                sym, rank = sym[~gone], rank[~gone]
                name, size, low = name[~ended], size[~ended], low[~ended]
                if not len(size):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # overlapping places of one pair (aaa): every other one, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            if not fresh.all():
                group = np.cumsum(fresh) - 1
                hit = hit[(hit - hit[fresh][group]) % 2 == 0]
            word = np.searchsorted(np.cumsum(size), hit, "right")
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            sym[hit] = self.made[rank[hit]]
            drop = hit + 1
            last[hit] = last[drop]
            keep = np.ones(len(sym), bool)
            keep[drop] = False
            at = hit - np.arange(len(hit))
            sym, rank, last = sym[keep], rank[keep], last[keep]
            size = size - np.bincount(word, minlength=len(size))
            changed = np.concatenate([at, at[at > 0] - 1])
            inner = changed[~last[changed]]
            rank[changed] = _NONE
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(owner, kind="stable")], counts

    def _ids_of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words given as spans."""
        hashes = flat.span_hashes(raw, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > CACHE_WORDS:
            self._reset()
        at = np.searchsorted(self._known, distinct)
        at[at == len(self._known)] = 0
        new = self._known[at] != distinct if len(self._known) else np.ones(len(distinct), bool)
        if new.any():
            s, e = starts[first[new]], ends[first[new]]
            ids, counts = self.merge_words(raw[flat.gather_index(s, e - s)], e - s)
            place = len(self._known_ids) + np.cumsum(counts) - counts
            hashes_all = np.concatenate([self._known, distinct[new]])
            order = np.argsort(hashes_all, kind="stable")
            self._known = hashes_all[order]
            self._known_at = np.concatenate([self._known_at, place])[order]
            self._known_len = np.concatenate([self._known_len, counts])[order]
            self._known_ids = np.concatenate([self._known_ids, ids])
            at = np.searchsorted(self._known, distinct)
        begin, length = self._known_at[at][which], self._known_len[at][which]
        return self._known_ids[flat.gather_index(begin, length)], length

    def encode_flat(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[offsets[i]:offsets[i + 1]] and their offsets."""
        texts = len(offsets) - 1
        whole = raw.tobytes()
        if any(s.encode() in whole for s in self.special):
            return self._encode_special(whole, offsets)
        if texts == 1 and len(raw) > 2 * flat.CHUNK_BYTES:
            return self._encode_long(raw)
        return self._encode_plain(raw, offsets)

    def _encode_plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if len(raw) and int(raw.max()) >= 128:
            points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            begins = token_starts(points, np.searchsorted(at, offsets))
            starts = at[begins]
        else:
            starts = token_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        ids, counts = self._ids_of(raw, starts, ends)
        if not np.array_equal(self.bytes_of(ids), raw):  # two words met in one hash
            self._reset()
            ids, counts = self.merge_words(raw, ends - starts)
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        return ids, total[np.searchsorted(starts, offsets)] if texts else np.zeros(1, np.int64)

    def _encode_long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long text, a part at a time. A part ends where a space follows a
        byte that is none: a token always begins there, so the ids are those of
        the whole; a text without such a place is one part."""
        cuts = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
        ends, at = [], 0
        while at < len(raw):
            k = np.searchsorted(cuts, at + flat.CHUNK_BYTES)
            at = int(cuts[k]) if k < len(cuts) else len(raw)
            ends.append(at)
        parts = [self._encode_plain(raw[a:b], np.array([0, b - a]))[0] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])

    def _encode_special(self, whole: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which a special token's text stands: what lies between is
        encoded as a text of its own, the special token becomes its id."""
        import re

        cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
        parts: list[bytes] = []
        after: list[int] = []
        pieces_of = [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text, at = whole[a:b], 0
            for m in cut.finditer(text):
                parts.append(text[at:m.start()])
                after.append(self.special[m[0].decode()])
                at = m.end()
            parts.append(text[at:])
            after.append(-1)
            pieces_of.append(len(parts))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        special, self.special = self.special, {}
        try:
            ids, ends = self.encode_flat(np.frombuffer(b"".join(parts), np.uint8), bounds)
        finally:
            self.special = special
        where = np.array(after)
        extra = np.concatenate([[0], np.cumsum(where >= 0)])
        out = np.insert(ids, ends[1:][where >= 0], where[where >= 0])
        at = np.array(pieces_of)
        return out, ends[at] + extra[at]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        return self.piece_bytes[flat.gather_index(self.piece_start[ids], self.piece_len[ids])]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row of ids, and their offsets."""
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.piece_len[ids], out=total[1:])
        return self.bytes_of(ids), total[offsets]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    return ByteBpe(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids binary) of every row of df.

    ids: the token ids of the whole text as little-endian unsigned 32-bit
    integers (``unpack_ids`` gives an array). The text of a special token is
    that token. Null or empty text: no ids. Null or repeated id_col values are
    passed through, a row for a row; other columns are not read, whatever
    their names.
    """
    path = path or default_path()
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for row, texts in flat.chunks(batch.column(1)):
                ids, ends = bpe.encode_flat(*flat.utf8(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.diff(ends)),
                     flat.binary_column(ids.astype("<u4"), ends)], names=[id_col, "n_tokens", "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of the packed ids.

    Bytes that are no UTF-8 become replacement characters. Null ids: null.
    The other columns stay; one called ``decoded`` is replaced.
    """
    path = path or default_path()
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            packed = batch.column(keep.index(ids_col))
            step = max(1, min(len(packed), (flat.CHUNK_BYTES * len(packed)) // max(1, packed.nbytes)))
            for row in range(0, len(packed), step):
                part = packed.slice(row, step)
                rows = [b"" if v is None else v for v in part.to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
                raw, at = bpe.decode_flat(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), ends)
                whole = raw.tobytes()
                texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                out = pa.array(texts, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, step) for i in range(len(keep))), out], names=[*keep, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def unpack_ids(packed: str) -> "F.Column":
    """array<long> of a column of packed ids."""
    text = F.hex(F.col(packed))
    def number(i):
        at = i * 8 + 1
        return F.conv(F.concat(*[F.substr(text, at + F.lit(k), F.lit(2)) for k in (6, 4, 2, 0)]), 16, 10).cast("long")
    n = (F.length(F.col(packed)) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), number))
