"""Exact lengths of repeated runs of lines, by brute force over all suffixes."""

import numpy as np
import pytest

from tracewright.llm import line_dedup


def longest(docs):
    """(row, n) -> (lines, row and line of the first suffix that agrees on so many), for rows in order of doc_id, null last."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    suffixes, out = [], {}
    for k in order:
        lines = docs[k][1].split("\n")
        for n in range(len(lines)):
            best = (0, None)
            for j, m, other in suffixes:
                same = 0
                while n + same < len(lines) and m + same < len(other) and lines[n + same] == other[m + same]:
                    same += 1
                if same > best[0]:
                    best = (same, (j, m))
            if best[0]:
                out[k, n] = best
            suffixes.append((k, n, lines))
    return out


def cases():
    r = np.random.default_rng(8)
    yield [(1, "x1\nx2\nx3\nx4"), (2, "x1\nx2\nx3\nx4\nx5\nx6\nx7"), (3, "x1\nx2\nx3\nx4\nx5\nx6\nx7")]
    yield [(k, "\n".join(r.choice(list("ab"), int(r.integers(1, 25))))) for k in range(12)]
    base = [f"l{m}" for m in range(40)]
    yield [(int(k), "\n".join([f"own{k}", *base[a : a + int(r.integers(1, 30))]])) for k, a in enumerate(r.integers(0, 30, 14))] + [(None, "\n".join(base[3:20])), (None, "")]
    yield [(1, "a\na\na\na\na\na\na"), (2, "a\na\na"), (2, "a\na\na\na\na\na\na\na\na\na\na\na\na")]


@pytest.mark.parametrize("docs", list(cases()))
def test_lengths_are_exact(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # rows are numbered in this order
    base, lines = line_dedup.lines_of(df)
    at = {r.row: k for k, r in enumerate(base.orderBy("row").collect())}
    got = {(at[r.row], r.n): (r["size"], (at[r["first"].row], r["first"].n)) for r in line_dedup.longest_copies(line_dedup.doubled(lines)).collect()}
    assert got == longest(docs)


def test_run_of_three_documents(spark):
    df = spark.createDataFrame(next(cases()), "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.start, r.lines, r.first_row, r.first_start) for r in line_dedup.repeated_runs(df).collect()}
    rows = {r.doc_id: r.row for r in line_dedup.lines_of(df)[0].collect()}
    assert got == {(2, 0, 4, rows[1], 0), (3, 0, 7, rows[2], 0)}
