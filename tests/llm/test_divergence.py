"""The source audit against plain counting, with exact integers."""

import collections
import re

import pytest

from tracewright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, g string, term string, p long"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))) for text, lang, source in rows]
    had, count = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, words in docs:
        had.update((lang, w) for w in set(words))
        count[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((w for (g, w), n in had.items() if g == lang and n >= least), key=str.encode)
        sources = sorted({s for g, s, _ in docs if g == lang})

        def p_of(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: p_of(count[lang, s]) for s in sources}
        q = p_of(sum((count[lang, s] for s in sources), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            parts = {"pair": [(sum(f(p[s][w], p[t][w]) for w in kept), t) for t in sources if t != s], "term": [(f(p[s][w], q[w]), w) for w in kept if count[lang, s][w] > 0 and p[s][w] > q[w]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked[: None if part == "pair" else top], 1)]
    return sorted(out)


def found(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(k, *r, 1, "g", "t", 2) for k, r in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = [f"w{x}" for x in "abcdefghijklmnopqrstuvwxyz"] + ["ÄPFEL", "äpfel", "İx", "日本", "🎉x", "x" * 400 + "a", "x" * 400 + "b", "x" * 400]
ROWS = [(" ".join(WORDS[(k * 7 + j * j) % len(WORDS)] + ("," if j % 3 else " 12 ") for j in range(k % 19)), ["en", "de", None][k % 3], ["s0", "s0", "s1", "s2", None, "É"][k * k % 6]) for k in range(120)]
ROWS += [(None, "en", "empty"), ("", "fr", "s0"), ("lonely words only here", "fr", "s1"), ("x\x00y\x1cz A_b", "en", "s0"), ROWS[5], ROWS[5]]


@pytest.mark.parametrize("least,top,block,pairs", [(3, 4, 512, 1 << 18), (1, 10, 2, 8), (10, 1, 1, 1)])
def test_against_counting(spark, monkeypatch, least, top, block, pairs):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "MOST_PAIRS", pairs)
    monkeypatch.setattr(divergence, "SLICE", 200)
    assert found(spark, ROWS, least=least, top=top) == brute(ROWS, least, top)


def test_ties_are_cut_by_their_bytes(spark):
    stem = "same" * 20
    names = [stem + a + b for a in "abcé" for b in ("", "a", "aa", "ab", "z" * 30, "é", "日")] + ["日", "ÿ", stem]
    rows = [(" ".join(names), "en", "mine"), ("other things", "en", "yours"), *[("", "en", f"s{k}") for k in range(3)]]
    for top in (1, 13):
        assert found(spark, rows, least=1, top=top) == brute(rows, 1, top)


def test_one_very_long_text(spark):
    rows = [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k % 17)}" for k in range(300_000)), "en", "long"), ("tab tac", "en", "short")]
    assert found(spark, rows, least=1) == brute(rows, 1, 10)


def test_empty(spark):
    assert found(spark, []) == []
