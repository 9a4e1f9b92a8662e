"""Fingerprints bit by bit, links by all pairs."""

import re

import numpy as np
import pytest
import xxhash

from tracewright.llm import simhash

SCHEMA = "doc_id long, text string, fp long, point long, component string"


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """The smallest place that links of two bits or fewer lead to."""
    a = np.array(values, np.uint64)
    name = list(range(len(a)))

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 2):
            x, y = top(i), top(int(j))
            name[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(a))]


BASE = " ".join(f"word{k} is{k % 7} here" for k in range(60))
TEXTS = [BASE, BASE.upper(), BASE.replace("word3 ", "other "), BASE + " more", None, "", " \n\t", "one", "One", "one two", "one two three", "one two  three", "one two three four", "é É ß", "x\x1cy z", "a b c " * 5000, "a b c " * 5001, "z" * 200_000]


def rows():
    out = [(k * 7 % 31 + 5, t) for k, t in enumerate(TEXTS)]
    return out + [(out[3][0], "another text of the same id"), (None, BASE), (None, "nobody else has this text"), out[0]]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    given = rows()
    df = spark.createDataFrame([(i, t, 3, 4, "c") for i, t in given], SCHEMA).repartition(3)
    fps = [fingerprint(t) for _, t in given]
    name, least = classes(fps), {}
    for (i, _), c in zip(given, name):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(given, fps, name)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    gone = {i for (i, _), c in zip(given, name) if i is not None} - {i for i, f, c in want if i == c}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in given if i is not None and i not in gone)


def test_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_links_of_planted_fingerprints(spark, hot):
    """Chains, crowds that share a segment, and strangers; whether compared or met at points, components are those of all pairs."""
    rng = np.random.default_rng(hot)
    some = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.int64) * 2 + rng.integers(0, 2, 60)]
    for base in some[:4]:
        for _ in range(40):  # around one fingerprint, many within two bits of another
            x = base
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            some.append(x)
    for part in (0xFFFFFFFF, 0xFFFFFFFF << 32):  # one segment in common, the rest anything
        some += [(some[5] & part) | (int(x) & ~part & (1 << 64) - 1) for x in rng.integers(0, 1 << 63, 30)]
    chain = some[9]
    for b in range(0, 64, 2):
        some.append(chain := chain ^ (3 << b))
    some = sorted({x & (1 << 64) - 1 for x in some} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, 1 << 31, 1 << 32})
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    links = simhash.close_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), hot).collect()
    at = {x: k for k, x in enumerate(signed)}
    assert all(bin((r.u ^ r.w) & (1 << 64) - 1).count("1") in (1, 2) for r in links)
    name = list(range(len(some)))

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for r in links:
        a, b = top(at[r.u]), top(at[r.w])
        name[max(a, b)] = min(a, b)
    assert [top(k) for k in range(len(some))] == classes(some)
