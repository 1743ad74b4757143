"""BPE against the tokenizers library, packing against the ids and rules themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kilowatt.llm import bpe, flat, packing

public_tokenizers = pytest.importorskip("public_tokenizers")

EDGE = ["", " ", "  ", "a  b", "a \n b", "don't we'll 'sam ''s 's's 'll'd'x", "  'tis", "x'", "\n\n\n", "é è  ü　x", "日本語テキスト",
        "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "aaaaaaaaaaaaa", "١٢٣ 12a", "\x85\x1c a", "🙂🙂 x", "'re've'm", "x" * 3000, "the " * 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def _texts():
    rnd = random.Random(1)
    alphabet = list(" \n\t'aAsStrevlmd1é日🙂., ́१")
    mixed = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    blocks = ["".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(k, k + 512)) for k in range(0, 0x3000, 512)]
    return EDGE + mixed + blocks


def test_ids_are_the_librarys(library):
    texts = _texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = bpe.load(bpe.default_path())
    for row, part in flat.chunks(pa.array(texts), 4096):
        ids, ends = own.encode_flat(*flat.utf8(part))
        for i in range(len(part)):
            assert ids[ends[i]:ends[i + 1]].tolist() == want[row + i]


def test_a_long_text_is_encoded_in_parts(monkeypatch, library):
    monkeypatch.setattr(flat, "CHUNK_BYTES", 300)
    rnd = random.Random(9)
    own = bpe.load(bpe.default_path())
    for alphabet in ("ab 'sé  \n.", "abc", "日本 語"):
        text = "".join(rnd.choice(alphabet) for _ in range(5000))
        ids, ends = own.encode_flat(*flat.utf8(pa.array([text], pa.large_string())))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]


def test_a_hash_that_two_words_share_is_found_out(monkeypatch, library):
    own = bpe.ByteBpe(bpe.default_path())
    monkeypatch.setattr(flat, "span_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    text = "the cat and the dog sat"
    ids, _ = own.encode_flat(*flat.utf8(pa.array([text], pa.large_string())))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "don't <|endoftext|> stop", "x"), (1, "don't <|endoftext|> stop", "x"), (None, None, None), (3, "", "y"), (4, "é日🙂 " * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "ids")
    enc = bpe.encode(df)
    got = bpe.decode(enc).withColumn("array", bpe.unpack_ids("ids")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for key, text, _ in rows:
        for r in by[key]:
            assert r["decoded"] == (text or "")
            assert r["array"] == library.encode(text or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["array"])
    assert bpe.encode(df.limit(0)).count() == 0


def test_packing_covers_every_id_once(spark, library):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma's", "12", "Ö"]) for _ in range(rnd.randint(0, 900)))) for i in range(120)]
    rows += [(None, None), (500, ""), (501, None), (7, "seven again"), (502, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", packing.F.lit(1)).repartition(3)
    pieces = packing.pack(df).collect()
    want = sorted((([-1] if k is None else [k]), library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows)
    windows, docs = {}, {}
    for p in pieces:
        assert p["length"] > 0
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)
    got = []
    for (key, n), parts in docs.items():
        ids = [x for _, p in sorted(parts) for x in p]
        while ids:  # rows that share id and length
            got.append(([-1] if key is None else [key], ids[:n]))
            ids = ids[n:]
    assert sorted(k for k, _ in got) == sorted(k for k, _ in want)
    assert sorted(len(x) for _, x in got) == sorted(len(x) for _, x in want)
    assert sorted(x for k, x in got if k != [7]) == sorted(x for k, x in want if k != [7])
    assert packing.padding(packing.pack(df)).first()["padding"] == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_a_place_has_the_least_sum_of_squares():
    rnd = random.Random(5)
    packer = packing.SquaresPacker(16)
    for _ in range(3000):
        size = rnd.randint(1, 15)
        before = packer.count.copy()
        options = {}
        for level in range(17):
            if (level == 0 or before[level]) and level + size <= 16:
                n = before.copy()
                n[level] -= level > 0
                if level + size < 16:
                    n[level + size] += 1
                options[level] = int((n ** 2).sum())
        packer.place(size, size)
        assert int((packer.count ** 2).sum()) == min(options.values())


def test_query_digests(spark, library):
    from kilowatt.llm import queries

    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    import hashlib

    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, "<u4")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    full = [r for r in queries.op9_packing(spark, "/root/testdata/sf0.001").collect() if r["start"] == 0 and r["length"] == r["doc_tokens"]]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in full[:50]:
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
