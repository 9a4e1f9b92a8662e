"""Words that a polynomial modulo a power of two can't tell apart, and words whose hashes are made to clash."""

import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewright.llm import common, near_dedup, tokens

U = np.uint64


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


PAIRS = [thue_morse(1024), thue_morse(4096)]
TEXTS = [w for p in PAIRS for w in p] + [f"{a} {b} {a}" for a, b in PAIRS] + ["x" * 8 + " " + "x" * 9 + " " + "x" * 16 + " X", "", "ß É İstanbul 日本語 don't", " a  b\tc "]


def test_word_hashes():
    buf, off = common.flat(pa.array(TEXTS))
    w = common.Words(buf, off)
    found = [buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert found == [x for t in TEXTS for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    low = [x.encode().lower() for x in found]  # bytes.lower() is that of ASCII
    h = w.hashes().tolist()
    assert len(set(zip(h, low))) == len(set(low)) == len(set(h))
    alone = [int(common.Words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes()[0]) for x in low]
    assert alone == h  # whatever stands around a word


@pytest.mark.parametrize("clash", [False, True])
def test_token_ids_are_exact(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(common.Words, "span_hash", lambda self, start, end: np.zeros(len(start), U))
    exact = Tokenizer.from_file(common.vocabulary_path(tokens.VOCABULARY))
    got = tokens.encoder().many(*common.flat(pa.array(TEXTS)))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [exact.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_shingles_of_long_words():
    a, b = PAIRS[0]
    sets = near_dedup.shingles(common.Words(*common.flat(pa.array([f"{a} one two three four five six", f"{b} one two three four five six"]))))
    assert [len(s) for s in sets] == [3, 3] and len(np.intersect1d(*sets)) == 2
