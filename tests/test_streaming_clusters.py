"""Clusters of a growing log are those of the whole log, with late records, restarts and full windows."""

import numpy as np
import pytest

from tracewright.operators import clustering, windows
from tracewright.streaming import clusters

SCHEMA = "line_idx long, ts_us long, label int, proposal int, username string, verb string, resource string, namespace string, name string, uid string, owner_uids array<string>, involved struct<kind:string,namespace:string,name:string,resource:string>, claim struct<kind:string,namespace:string,name:string>"
S = 1_000_000


def log(n=240):
    r = np.random.default_rng(2)
    pick = lambda *v: v[int(r.integers(len(v)))]
    rows, t = [], 0
    for i in range(n):
        t += int(r.integers(1, 40)) * S
        label = pick(17808, 61632, None)
        rows.append((i, t if i % 31 else None, label, pick(label, 5), pick("bob", "eve", "system:apiserver", None), pick("get", "create", "delete"), pick("pods", "namespaces", "limitranges"), pick("a", None), pick("a", "b", ""), pick("u", "v", None), pick([], ["u"]), pick(None, ("Pod", "a", "b", "pods")), pick(None, ("C", "a", None))))
    return rows


@pytest.mark.parametrize("merge,most", [(False, 1000), (True, 6)])
def test_stream_gives_the_clusters_of_the_batch(spark, tmp_path, merge, most):
    rows = log()
    source, out = str(tmp_path / "log"), str(tmp_path / "clusters")
    late = "200 seconds"
    base = [r for r in rows if r[2] is not None and r[1] is not None]
    order = sorted(base, key=lambda r: r[1] + (150 * S if r[0] % 5 == 0 else 0))  # some come 150 seconds late
    seen = 0
    for k in range(0, len(order), 60):
        spark.createDataFrame(order[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = clusters.run(spark, source, spark.createDataFrame([], SCHEMA).schema, out, late=late, merge=merge, most=most)  # each run takes up the state of the one before
        now = got.count()
        assert now >= seen
        seen = now
    assert 0 < seen < len(base)  # the last windows are still open
    end = max(r[1] for r in base) + 3600 * S
    spark.createDataFrame([(10_000, end, 99, 0, *[None] * 9)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    got = clusters.run(spark, source, spark.createDataFrame([], SCHEMA).schema, out, late=late, merge=merge, most=most).collect()
    want = clustering.clustered(spark.createDataFrame(base, SCHEMA), merge, most=most).collect()
    assert {r.line_idx: (r.label, r.cluster_id) for r in got} == {r.line_idx: (r.label, r.cluster_id) for r in want} and len(got) == len(base)
    start = {r.line_idx: r.window_start for r in windows.anchored_windows(spark.createDataFrame(base, SCHEMA), ["label"], most=most).collect()}
    assert {r.line_idx: r.window_start for r in got} == start and len({r.cluster_id for r in got}) < len(base)


def test_windows_close_in_order():
    rows = [{"line_idx": k, "ts_us": t} for k, t in enumerate([0, 10, 20, 120, 130, 500])]
    cut = lambda mark, most=99: [[r["line_idx"] for r in w] for w in clusters.closed(rows, mark, 100, most)[0]]
    assert cut(100) == [] and cut(101) == [[0, 1, 2]] and cut(221) == [[0, 1, 2], [3, 4]] and cut(601) == [[0, 1, 2], [3, 4], [5]]
    assert cut(11, 2) == [[0, 1]] and cut(10, 2) == []


def test_late_beyond_the_watermark_is_dropped(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "clusters")
    row = lambda i, t: (i, (t + 5000) * S, 61632, 0, "u", "get", "pods", None, "p", None, [], None, None)
    for batch in ([row(1, 0), row(2, 1000)], [row(3, 10)], [row(4, 9000)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = clusters.run(spark, source, spark.createDataFrame([], SCHEMA).schema, out)
    assert {r.line_idx for r in got.collect()} == {1, 2}


def test_records_wait_as_text():
    from tracewright.streaming import clusters

    text = '{"line_idx":3,"ts_us":7,"label":1,"username":"u","verb":"get","resource":"pods"}'
    assert clusters.light(text) == {"line_idx": 3, "ts_us": 7, "text": text} and clusters.resolved(text)["username"] == "u"
