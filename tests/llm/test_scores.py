"""Scores of the language model and of the toxicity model, taken once more from the fitted numbers, word by word."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import common, lm_score, toxicity

U = np.uint64
SCHEMA = "doc_id long, text string"


def hashed(word: bytes) -> int:
    return int(common.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes()[0])


def test_language_model_scores(spark, monkeypatch):
    r = np.random.default_rng(6)
    words = ["the", "cat", "sat", "on", "a", "mat", "dogs", "Run", "É", "far"] + [f"w{k}ing" for k in range(400)]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(k, " ".join(r.choice(words, int(r.integers(0, 60)), p=p / p.sum()))) for k in range(120)] + [(500, None), (501, ""), (502, "onlyhere words"), (None, "the cat"), (3, "THE cat sat")]
    held = {}
    scorer = lm_score.scorer
    monkeypatch.setattr(lm_score, "scorer", lambda buckets, classes, model: held.update(classes=classes.value, model=model.value) or scorer(buckets, classes, model))
    got = lm_score.scores(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    known, lm = held["classes"], held["model"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    count = collections.Counter(w for i, t in docs if not out(i) for w in split(t))
    own = {int(w): k for k, w in enumerate(known.words)}
    assert len(own) == known.end < len(count)  # rarer words share suffix classes
    kind = lambda w: hashed(w[-3:]) % lm_score.SUFFIXES
    cls = lambda w: own.get(hashed(w), known.end + 1 + kind(w))
    tokens, types = collections.Counter(), collections.Counter()
    for w, n in count.items():
        if hashed(w) not in own:
            tokens[kind(w)] += n
            types[kind(w)] += 1
    chance = {}

    def log10_of(two, one, c):
        """The whole distribution of a context, normalised plainly."""
        if (two, one) not in chance:
            q = lm.context[two].astype(float) @ lm.place[0] + lm.context[one].astype(float) @ lm.place[1]
            z = lm.target.astype(float) @ q + lm.bias
            e = np.exp(z - z.max())
            chance[two, one] = e / e.sum()
        return math.log10(chance[two, one][c])

    want = []
    for i, t in docs:
        two = one = known.end
        score = 0.0
        for w in split(t):
            c = cls(w)
            score += log10_of(two, one, c)
            if c > known.end:  # within its class by its count, an unseen word like one more
                score += math.log10(count[w] + 1) - math.log10(tokens[kind(w)] + types[kind(w)] + 1)
            two, one = one, c
        want.append((i, score + log10_of(two, one, known.end)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (i, a), (j, b) in zip(sorted(want, key=key), sorted(((r.doc_id, r.score) for r in got), key=key), strict=True):
        assert i == j and b == pytest.approx(a, abs=1e-3, rel=1e-4)


STOPS, WORD = re.compile(rb"[.!?;\n]"), re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def features(word: bytes) -> list[int]:
    """The word's own feature and those of its leads; a shorter word stands for itself."""
    whole = hashed(word)
    out = [whole >> 32]
    for k in toxicity.LEADS:
        out.append(((hashed(word[:k]) * int(common.C1) + k) % (1 << 64)) >> 32 if len(word) >= k else whole >> 32)
    return out


def test_toxicity_scores(spark):
    vocabulary = [b"bad", b"worse", b"dreadful", b"nice", b"friendly", "übel".encode()]
    told = {}
    for k, w in enumerate(vocabulary):
        for j, f in enumerate(features(w)):
            told.setdefault(f, 1.5 * (k % 3) - 0.5 + 0.1 * j)
    names = np.array(sorted(told), np.uint32)
    model = toxicity.Model(names, np.array([told[int(f)] for f in names]), -3.0)
    texts = ["This is BAD. It gets worse; dreadful! nice", "friendly friends, dreadfully friendly\nbad bad bad", "", None, "...", "nothing at all here", "Übel übel. übelst", "x" * 300 + " bad", "bad" * 50, "worse? worse?"]
    got = {r.doc_id: r for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), SCHEMA), model).collect()}
    for i, t in enumerate(texts):
        clean, worst = 1.0, 0.0
        for part in STOPS.split((t or "").encode().lower()):
            words = WORD.findall(part)
            if words:
                z = -3.0 + sum(told.get(f, 0.0) for w in words for f in features(w))
                p = 1 / (1 + math.exp(-max(-30, min(30, z))))
                clean, worst = clean * (1 - min(p, 1 - 1e-12)), max(worst, p)
        assert got[i].score == pytest.approx(1 - clean, abs=1e-9) and got[i].worst_score == pytest.approx(worst, abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert len({round(r.score, 6) for r in got.values()}) > 5
