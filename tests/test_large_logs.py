"""What large logs cost: code that the JVM compiles, and nothing reckoned twice."""

import numpy as np
import pytest

from tracewright import registry
from tracewright.operators import clustering, sequence, windows
from tracewright.sources import audit

SF = "/root/testdata/sf0.001"
#: Bytes of a method beyond which the JVM only interprets it.
COMPILED = 8000


def largest_method(spark, df) -> int:
    made = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size()))


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_code_of_the_view_is_compiled(plain_plans):
    assert largest_method(plain_plans, audit.audit_view(plain_plans, SF, True).select("line_idx", "line")) < COMPILED
    assert largest_method(plain_plans, registry.labelled(plain_plans, SF)) < COMPILED


@pytest.mark.parametrize("most", [1, 2, 3, 10, 1000])
def test_windows_of_falling_timestamps_without_a_step_a_row(most, monkeypatch):
    rng = np.random.default_rng(most)
    for t in (np.tile(np.sort(rng.integers(0, 5000, 700)), 3), np.cumsum(rng.integers(-3, 9, 1500)), np.array([5, 4]), np.array([9, 1, 30])):
        want = [next((j for j in range(i + 1, min(i + most, len(t))) if t[j] - t[i] > 40), i + most) for i in range(len(t))]
        with monkeypatch.context() as m:
            m.delattr(windows.np, "flatnonzero")
            got = windows.next_starts(t, 40, most)
        assert got.tolist() == want


def kept(monkeypatch, module) -> list[str]:
    names, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda s, df, name: names.append(name) or real(s, df, name))
    return names


def test_clusters_are_made_once(spark, monkeypatch):
    names = kept(monkeypatch, clustering)
    registry.f10_cluster_log(spark, SF).count()
    assert names == ["marked", "assigned"]


def test_lines_bring_what_stands_beside_them(spark):
    got = registry.labelled_records(spark, SF, "user_id").select("line_idx", "user_id")
    want = audit.audit_view(spark, SF).select("line_idx", "user_id")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_classifiers_share_stored_features(spark, monkeypatch):
    names = kept(monkeypatch, sequence)
    rows = spark.range(60).selectExpr("id AS line_idx", "'x' AS who", "CAST(id % 3 AS STRING) AS c", "CAST(17808 AS INT) AS label")
    assert sequence.train_bundle(rows, ["c"], ["who"]).infer(rows).count() == 60
    assert names == ["features"]
