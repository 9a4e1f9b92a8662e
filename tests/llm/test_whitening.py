"""Whitening against numpy on all rows."""

import math

import numpy as np
import pytest

from tracewright.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, c0 string, n long, x int"
RNG = np.random.default_rng(5)
GOOD = (RNG.normal(size=(60, 10)) @ RNG.normal(size=(10, 10)) + RNG.normal(size=10)).tolist()
BAD = [None, [], [1.0] * 9, [0.5] * 11, [math.nan] + [1.0] * 9, [1.0] * 9 + [math.inf], [None] + [1.0] * 9, [-math.inf] * 10, [1e300] * 10]


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, v, "c", -1, 7) for k, v in enumerate(vectors)], SCHEMA)


def expected(vectors, most=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * c - t) ** 2 for c, t in zip(r, s))) for r in x]
    y = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, y @ vectors[:, :most] / np.sqrt(values[:most]), values / values.sum()


def test_against_numpy(spark):
    vectors = GOOD + GOOD[:3]  # repeated vectors are rows of their own
    df = frame(spark, vectors[:30] + BAD[:5] + vectors[30:] + BAD[5:]).unionByName(frame(spark, [GOOD[7]], 3)).repartition(5)  # a vec_id that is there twice
    rows = whitening.whiten(df).collect()
    n, deviation, z, share = expected(vectors + [GOOD[7]])
    assert len(rows) == 8 * n and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 9))
    ids = [k + 5 * (k >= 30) for k in range(len(vectors))] + [3]
    want = sorted((i, k + 1, d, round(abs(float(w)), 8), round(float(share[k]), 8)) for i, d, row in zip(ids, deviation, z) for k, w in enumerate(row))
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 8), round(r.explained, 8)) for r in rows) == want
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r.whitened for r in rows if r.vec_id != 3}
    for k in range(8):  # one sign for all rows of a component
        assert len({by[i, k + 1] * w > 0 for i, w in zip(ids, z[:, k]) if i != 3}) == 1


@pytest.mark.parametrize("scale", [1e-3, 1e6, 1e11])
def test_sizes_of_entries(spark, scale):
    vectors = [[c * scale for c in v] for v in GOOD]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    n, deviation, z, share = expected(vectors)
    for r in rows:
        d = deviation[r.vec_id]
        assert r.deviation == (d if d < 1 << 63 else None)
        assert abs(r.whitened) == pytest.approx(abs(z[r.vec_id][r.component - 1]), abs=1e-6) and r.explained == pytest.approx(share[r.component - 1], rel=1e-6)
    assert rows[0].identity_error < 1e-4


def test_few_dimensions_and_no_variance(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 2.0, 3.0]] * 4)).collect()
    assert len(rows) == 12 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None and r.explained is None for r in rows)
    rows = whitening.whiten(frame(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])).collect()  # on a line
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in rows) == [(i, c, c == 2) for i in range(3) for c in (1, 2)]
    assert rows[0].identity_error < 1e-9


def test_nothing_left(spark):
    for vectors in ([], [None, []], [[math.nan]]):
        out = whitening.whiten(frame(spark, vectors))
        assert out.collect() == [] and [f.name for f in out.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
