"""What a labeller is shown, by plain loops over a log."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import labels
from tracewright.operators import labelling, windows

SCHEMA = "line_idx long, ts_us long, has_ref boolean, uri string, verb string, api_group string, api_version string, resource string, subresource string, namespace string, name string, username string, label int, cplabel boolean"


def log(n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        resource = rng.choice(["pods", "nodes", "secrets", "tokenreviews", "nothing"])
        group, version = ("authentication.k8s.io", "v1") if resource == "tokenreviews" else (None, "v1")
        rows.append((3 * k, rng.randrange(10**9), rng.random() > 0.1, rng.choice(["/api/v1/x/y", "/api/v1/x/y?watch=1", "/healthz"]), rng.choice(["get", "get", "get", "list", "watch", "create", "update", "patch", "delete", "deletecollection"]), group, version, resource, None, rng.choice(["", None, "web", "falco"]), rng.choice([None, "", "one"]), rng.choice(["system:node", "alice", None]), rng.choice([None, None, -1, -2, 61616]), rng.choice([True, True, True, None, False])))
    return rows


@pytest.mark.parametrize("n,size", [(150, windows.CHUNK), (150, 40), (41, 40), (1, 40)])
def test_context(spark, monkeypatch, n, size):
    monkeypatch.setattr(windows.in_chunks, "__defaults__", (*windows.in_chunks.__defaults__[:-1], size))
    rows = log(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    told = {v: {r.line_idx: r.proposal for r in labels.propose(df.withColumn("verb", F.lit(v)) if v else df).collect()} for v in (None, "create", "delete", "watch", "patch")}
    at = lambda x: dict(zip(SCHEMA.replace(",", "").split()[::2], rows[x]))
    want = {}
    for x in range(n):
        r = at(x)
        if r["label"] not in (None, -1):
            continue
        out = {"line_idx": r["line_idx"], "proposal": told[None][r["line_idx"]], **{f"{v}_label": told[v][r["line_idx"]] for v in ("create", "delete", "watch", "patch")}}
        for name, verbs in (("next_watch", ["watch"]), ("next_create", ["create"]), ("next_patch", ["patch", "update"]), ("next_delete", ["delete", "deletecollection"])):
            out[name], out[f"{name}_after"] = -1, None
            for i in range(1, min(20, n - x)):
                if at(x + i)["verb"] in verbs:
                    out[name], out[f"{name}_after"] = told[None][rows[x + i][0]], i
                    break
        out["next_action"], out["next_action_after"] = -1, None
        for i in range(1, min(40, n - x)):
            if not at(x + i)["cplabel"] and not (at(x + i)["username"] or "").startswith("system:"):
                out["next_action"], out["next_action_after"] = told[None][rows[x + i][0]], i
                break
        out["before_us"] = abs(rows[x - 1][1] - rows[x][1])  # of the first one the last
        for i in range(1, 5):
            out[f"after{i}_us"] = abs(rows[x + i][1] - rows[x][1]) if x + i < n else None
        want[r["line_idx"]] = out
    assert {r.line_idx: r.asDict() for r in labelling.context(df).collect()} == want
    assert labelling.context(df, open_only=False).count() == n


def test_labels_of_other_verbs_by_hand(spark):
    """A token review can only be created; a node can't be reviewed; a record without a catalog entry has no label with any verb."""
    rows = [(0, 0, True, "/apis/authentication.k8s.io/v1/tokenreviews", "create", "authentication.k8s.io", "v1", "tokenreviews", None, None, None, "u", None, None), (1, 5, True, "/api/v1/nodes/n", "get", None, "v1", "nodes", None, None, "n", "u", None, None), (2, 9, True, "/api/v1/x/y", "get", None, "v1", "nothing", None, None, None, "u", None, None)]
    got = {r.line_idx: r for r in labelling.context(spark.createDataFrame(rows, SCHEMA)).collect()}
    space = {r.label for r in labels.label_space(spark).collect()}
    assert got[0].create_label == got[0].proposal != -1 and (got[0].delete_label, got[0].watch_label, got[0].patch_label) == (-1, -1, -1)
    assert all(x != -1 for x in (got[1].create_label, got[1].delete_label, got[1].watch_label, got[1].patch_label))
    assert {got[2].proposal, got[2].create_label, got[2].watch_label} == {-1}
    assert all(r[c] in space for r in got.values() for c in ("proposal", "create_label", "delete_label", "watch_label", "patch_label"))


def test_verbs_that_there_are_not(spark):
    df = spark.createDataFrame([("get",), ("watch",), ("fly",), (None,)], "verb string")
    assert [r[0] for r in df.select(labels.verb_id(F.col("verb"))).collect()] == [3, 5, None, None]
    assert [r[0] for r in df.filter("verb IN ('get', 'watch')").select(labels.verb_id(F.col("verb"), strict=True)).collect()] == [3, 5]
    with pytest.raises(Exception, match="not a verb: fly"):
        df.select(labels.verb_id(F.col("verb"), strict=True)).collect()


def test_records_are_reckoned_once(spark, monkeypatch):
    """What context() proposes is stored before ranges are sampled, dealt and asked for the last record."""
    kept, names = labelling.stored, []
    monkeypatch.setattr(labelling, "stored", lambda s, df, name: names.append(name) or kept(s, df, name))
    asked = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(spark.createDataFrame(log(60), SCHEMA).rdd.map(lambda r: asked.add(1) or r), SCHEMA)
    assert labelling.context(df, open_only=False).count() == 60 and names == ["told"] and asked.value == 60
