"""Embedding whitening: covariances by column aggregates of generated SQL expressions, decomposed with LAPACK.

An entry c of a vector counts as the integer x = floor(1024 * c) + 100000. Three aggregations over all vectors, each of
a fixed number of columns and combined before anything is sent on:

* the number of vectors and each dimension's sum, smallest and largest value;
* for every pair of dimensions (the upper triangle) the sum of the products of both, centred at the whole number below
  the mean. The sums are exact integers wherever the ranges found before prove that they fit, else doubles; what the
  fractions of the means make up is taken off exactly on the driver;
* the covariances of the whitened columns, which should be the identity.

The driver holds numbers of dimensions alone, never rows. Whitening itself is a projection of generated expressions.

A null vector, and one with null or non-finite entries, is dropped. Vectors of another length than most (of ties the
longest) are dropped as well, as they have no place in the same covariances. Rows that repeat a vec_id, or a vector, are rows of their own.
A component without variance (fewer different vectors than dimensions) has null in whitened, and takes no part in
identity_error. A deviation beyond 64 bits is null. Entries must be below 2**52 in size, or the row is dropped as non-finite ones are. An
empty table, or none but empty vectors, gives no rows. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from this size on have no exact integer.
LARGEST = float(1 << 52)
#: An eigenvalue below this share of the largest is none.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """What the fit found: n vectors, sums of each dimension, eigenvalues (falling), their unit vectors as rows, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: The largest |n * x - sum| there can be.
    reach: int

    def components(self, most: int = COMPONENTS) -> list[tuple[int, bool]]:
        """Numbers of the first components and whether they have variance."""
        return [(k, bool(self.values[k] > LEAST_SHARE * self.values[0] > 0)) for k in range(min(most, len(self.sums)))]

    def centred(self) -> list[Column]:
        """n * x - sum of every dimension, exact; the integers are in a column x."""
        kind = "long" if self.reach < 1 << 62 else "decimal(38,0)"
        base = [s // self.n for s in self.sums]
        return [F.lit(self.n).cast(kind) * (F.get("x", F.lit(i)) - F.lit(b).cast("long")).cast(kind) - F.lit(s - self.n * b).cast(kind) for i, (s, b) in enumerate(zip(self.sums, base))]

    def deviation(self) -> Column:
        kind = "long" if len(self.sums) * self.reach**2 < 1 << 63 else "decimal(38,0)"
        total = sum((F.col(f"c{i}").cast(kind) * F.col(f"c{i}").cast(kind) for i in range(1, len(self.sums))), F.col("c0").cast(kind) * F.col("c0").cast(kind))
        return total if kind == "long" else total.try_cast("long")

    def whitened(self, k: int) -> Column:
        weights = self.vectors[k] / np.sqrt(self.values[k]) / self.n
        return sum((F.col(f"c{i}").cast("double") * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def whole_vectors(rows: DataFrame, column: str) -> DataFrame:
    """vec_id and x, the integers of the vectors that stay."""
    good = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    fine = rows.filter(F.col(column).isNotNull() & good & (F.size(column) > 0)).select("vec_id", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))
    most = fine.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.filter(F.size("x") == (most.d if most else 0))


def pair_sums(x: DataFrame, base: list[int], exact: bool) -> list:
    """Over all rows, the sums of (x_i - base_i) * (x_j - base_j) for i <= j, in one aggregation."""
    d = len(base)
    kind = "BIGINT" if exact else "DOUBLE"
    columns = x.selectExpr(*[f"CAST(x[{i}] - {b} AS {kind}) AS y{i}" for i, b in enumerate(base)])
    return list(columns.selectExpr(*[f"sum(y{i} * y{j}) AS p{i}_{j}" for i in range(d) for j in range(i, d)]).first())


def fit(x: DataFrame) -> Whitening | None:
    """Means and principal components of all rows of x; None without rows."""
    head = x.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    d = head.d
    told = x.selectExpr("count(*) AS n", *[f"{f}({'CAST(' * (f == 'sum')}x[{i}]{' AS DECIMAL(38,0))' * (f == 'sum')}) AS {f}{i}" for f in ("sum", "min", "max") for i in range(d)]).first()
    n, sums = told.n, [int(told[f"sum{i}"]) for i in range(d)]
    base = [s // n for s in sums]
    reach = max(max(told[f"max{i}"] - base[i], base[i] - told[f"min{i}"]) + 1 for i in range(d))
    exact = n * reach**2 < 1 << 63
    got, at = pair_sums(x, base, exact), 0
    cov = np.zeros((d, d))
    left = [s - n * b for s, b in zip(sums, base)]  # what the whole numbers below the means leave over
    for i in range(d):
        for j in range(i, d):
            p = got[at]
            cov[i, j] = cov[j, i] = (n * p - left[i] * left[j]) / (n * n) if exact else p / n - left[i] / n * (left[j] / n)
            at += 1
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, ::-1].T.copy()
    vectors[np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)[:, 0] < 0] *= -1
    return Whitening(n, sums, values[::-1].copy(), vectors, float(np.trace(cov)), n * reach)


def whiten(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Of each vector that stays and each of the first components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = whole_vectors(rows, column)
    model = fit(x)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    wide = x.select("vec_id", *[c.alias(f"c{i}") for i, c in enumerate(model.centred())])
    parts = model.components(most)
    varied = [k for k, ok in parts if ok]
    scores = wide.select("vec_id", model.deviation().alias("deviation"), *[model.whitened(k).alias(f"w{k}") for k in varied])
    error = None
    if varied:
        pairs = [(i, j) for i in varied for j in varied if i <= j]
        got = scores.select(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs))
    each = [F.struct(F.lit(k + 1).alias("component"), (F.col(f"w{k}") if ok else F.lit(None).cast("double")).alias("whitened"), F.lit(float(max(model.values[k], 0) / model.trace) if model.trace > 0 else None).cast("double").alias("explained")) for k, ok in parts]
    return scores.select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.inline(F.array(*each))).select(
        "vec_id", F.col("component").cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
