"""Texts longer than a chunk are counted in pieces, with the results of whole texts and bounded memory."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from kilowatt.llm import flat, langid, minhash, toxicity


def _text(seed, words=400):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "g", "don't", "é́tude", "x,y", "--", "日本語", "42", "ÄÖ", "end."]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", "-"]) for _ in range(words))


TEXTS = [_text(1), _text(2, 3), "w" * 900, "w" * 400 + " " + "v" * 500, "a b " + "c" * 600 + " d", " " * 700, "a b c d e " + " " * 400, " " * 400 + "a b c d",
         "one two three four " + "." * 300 + " five six", _text(3, 2000)]


@pytest.mark.parametrize("chunk", [16, 50, 200])
@pytest.mark.parametrize("text", TEXTS)
def test_pieces_add_up(monkeypatch, chunk, text):
    texts = pa.array([text], pa.large_string())
    whole = [langid.grams(texts), minhash.shingles(texts), toxicity._distinct(*toxicity.features(texts))]
    monkeypatch.setattr(flat, "CHUNK_BYTES", chunk)
    parts = [p[0].as_py() for p in flat.pieces(texts)]
    assert "".join(parts) == text and (len(parts) > 1 or " " not in text[chunk:])
    for got, want in zip([langid.grams(texts), minhash.shingles(texts), toxicity._distinct(*toxicity.features(texts))], whole, strict=True):
        for a, b in zip(got, want, strict=True):
            assert np.array_equal(a, b)


def test_shingles_of_texts_of_all_lengths(monkeypatch):
    texts = pa.array([*TEXTS, None, ""], pa.large_string())
    monkeypatch.setattr(flat, "CHUNK_BYTES", 1 << 30)
    whole = minhash.shingles(texts)
    monkeypatch.setattr(flat, "CHUNK_BYTES", 100)
    assert all(np.array_equal(a, b) for a, b in zip(minhash.shingles(texts), whole, strict=True))


@pytest.mark.parametrize("work", ["langid.grams(t)", "minhash.shingles(t)", "toxicity.features(t)"])
def test_memory_of_a_text_of_20_mb(work):
    code = f"""
import resource, numpy as np, pyarrow as pa
from kilowatt.llm import langid, minhash, toxicity
rng = np.random.default_rng(0)
words = np.array(["w%d" % i for i in range(50000)])
t = pa.array([" ".join(words[rng.integers(0, 50000, 3_400_000)])], pa.large_string())
small = pa.array(["a b c d e f"], pa.large_string())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{work}
print(t.nbytes >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 18 and int(out[1]) < 600, out
