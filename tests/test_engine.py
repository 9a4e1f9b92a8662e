"""Hand-made records with answers worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import catalog, labels, rules, scalars
from tracewright.operators import clustering, metrics, sequence, windows
from tracewright.plans.reduce import reduced
from tracewright.session import scratch, stored
from tracewright.sources import audit

SCHEMA = "line_idx long, has_ref boolean, uri string, verb string, api_group string, api_version string, resource string, subresource string, namespace string, name string"


def record(i, verb, resource, group=None, sub=None, ns=None, name=None, uri="/api/v1/x", version="v1"):
    return (i, True, uri, verb, group, version, resource, sub, ns, name)


def proposals(spark, rows):
    return {r.line_idx: r.proposal for r in labels.propose(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_worked_labels(spark):
    got = proposals(
        spark,
        [
            record(1, "update", "leases", "coordination.k8s.io", ns="kube-system", name="a", uri="/apis/c/v1/leases"),
            record(2, "patch", "nodes", name="n"),
            record(3, "get", "nodes", name="n"),
            record(4, "create", "serviceaccounts", sub="token", ns="a", name="b"),
            record(5, "get", "nodes", sub="proxy", name="n"),
            record(6, "get", "widgets", "example.com", ns="a", uri="/apis/example.com/v1/widgets"),
            record(7, "get", "flowschemas", "flowcontrol.apiserver.k8s.io", uri="/apis/f/v1/flowschemas"),
            record(8, "get", "pods", uri="/healthz"),
            record(9, "get", "pods", uri="/api/v1"),
            record(10, "get", "pods", ns="falco"),
            record(11, "connect", "pods", ns="a"),
            record(12, "get", "bindings", ns="a"),
            (13, False, "/api/v1/x", "get", None, None, None, None, None, None),
        ],
    )
    assert [got[i] for i in range(1, 6)] == [119232, 61632, 61616, 17808, 61617]
    assert got[6] // 4096 == 666
    assert [got[i] for i in range(7, 14)] == [-1, -2, -2, -2, -1, -1, -1]


def test_label_space_and_round_trip(spark):
    space = labels.label_space(spark)
    assert space.count() == 1357
    d = labels.decoded(space.filter("label >= 0"))
    back = labels.encode(F.col("type_id"), F.col("sub_id"), F.col("is_namespaced"), F.col("is_single"), F.col("verb_id"))
    assert d.filter(back != F.col("label")).count() == 0
    assert d.filter("error").count() == 0
    assert labels.decoded(spark.createDataFrame([(-1,), (5,)], "label int")).filter("error").count() == 2


def test_catalog():
    rows = catalog.catalog_rows()
    assert len(rows) == 98 and len({r[0] for r in rows}) == 21 and sum(r[5] for r in rows) == 60 and len({r[3] for r in rows}) == 58
    with pytest.raises(ValueError):
        catalog.parse_catalog("core,v1,pods,1,0,true,create\ncore,v1,pods,1,1,true,create")
    with pytest.raises(ValueError):
        catalog.parse_catalog("core,v1,pods,1,0,true,create\ncore,v1,services,1,0,true,create")
    assert catalog.parse_catalog("#group,and,so,on\ncore,v1,pods,1,0,true,create,,,get,,,,watch\n") == [("core", "v1", "pods", 1, 0, True, ["create", "get", "watch"])]
    by = {r[:3]: r[3:] for r in rows}
    assert by["core", "v1", "nodes/proxy"] == (15, 8, False, ["create", "delete", "get", "patch", "update"])
    assert by["coordination.k8s.io", "v1", "leases"] == (29, 0, True, ["create", "delete", "deletecollection", "get", "list", "patch", "update", "watch"])
    assert catalog.parse_verbs("#verb,id\nget,3\n") == {"get": 3} and catalog.VERB_IDS["deletecollection"] == 2
    assert catalog.parse_toggles("[ignore_log]\na = True\nb = False\nc = off\n") == ("b", "c")


def lines(tmp_path, rows):
    path = tmp_path / "log.json"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_jsonl_presence_and_null(spark, tmp_path):
    base = {"requestURI": "/api/v1/pods", "verb": "get", "stage": "ResponseComplete", "requestReceivedTimestamp": "2024-01-01T00:00:00.000001Z", "user": {"username": "u", "groups": ["a"]}}
    path = lines(tmp_path, [base | {"objectRef": {"resource": "pods", "namespace": None}}, base | {"objectRef": {"resource": "pods"}}, base, "", "{broken", base | {"requestReceivedTimestamp": "never"}])
    got = audit.read_tolerant(spark, path).orderBy("line_idx").collect()
    assert [(r.has_ref, r.has_namespace_key, r.namespace) for r in got] == [(True, True, None), (True, False, None), (False, False, None)]
    assert got[0].ts_us % 10 == 1 and got[0].user_groups == ",a,"
    with pytest.raises(Exception):
        audit.read_audit_jsonl(spark, path, strict=True).count()
    out = str(tmp_path / "out")
    audit.write_jsonl(audit.read_tolerant(spark, path), out)
    written = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(written) == 3 and all(w["verb"] == "get" for w in written) and sum("objectRef" in w and "namespace" in w["objectRef"] for w in written) == 1


def test_uid_and_features(spark, tmp_path):
    rows = [{"verb": "get", "responseObject": {"metadata": {"uid": None}, "details": {"uid": "x"}}}, {"verb": "list", "responseObject": {"details": {"uid": "y"}}, "annotations": {"authorization.k8s.io/decision": "allow"}}, {"verb": "patch", "responseStatus": {"details": {"uid": "z"}}, "a": {"b": [1, {"c": "d"}], "e": {}}}]
    df = audit.read_audit_jsonl(spark, lines(tmp_path, rows))
    assert [r.u for r in df.orderBy("line_idx").select(scalars.uid().alias("u")).collect()] == [None, "y", "z"]
    f = scalars.features(df)
    assert len(f.columns) == 40
    assert [r[0] for r in f.orderBy("line_idx").select(F.col("`annotations.authorization.k8s.io/decision`")).collect()] == [None, "allow", None]
    flat = {(r.path, r.value) for r in scalars.flattened(df).filter("path LIKE 'a.%'").collect()}
    assert flat == {("a.b[0]", "1"), ("a.b[1].c", "d")}
    deep: dict = {"x": 1}
    for _ in range(12):
        deep = {"d": [deep]}
    got = scalars.flattened(audit.read_audit_jsonl(spark, lines(tmp_path, [deep])))
    assert [(r.path, r.value) for r in got.collect()] == [(".".join(["d[0]"] * 12) + ".x", "1")]


def test_optional_parts(spark, tmp_path):
    def response(**parts):
        return {"responseObject": parts}

    rows = [
        response(metadata={"uid": "u", "ownerReferences": [{"uid": "a"}, {"kind": "k"}, {"uid": "b"}]}),
        response(metadata={"ownerReferences": {"uid": "c"}}, involvedObject={"kind": "Pod", "name": "n", "uid": "z"}),
        response(involvedObject={}, spec={"claimRef": {"kind": "C", "namespace": "s", "name": "m"}}),
        {"verb": "get"},
    ]
    got = audit.optional(audit.read_audit_jsonl(spark, lines(tmp_path, rows))).orderBy("line_idx").collect()
    assert [(r.uid, r.owner_uids) for r in got] == [("u", ["a", "b"]), (None, ["c"]), (None, []), (None, [])]
    assert [r.involved and tuple(r.involved) for r in got] == [None, ("Pod", None, "n", None), None, None]
    assert [r.claim and tuple(r.claim) for r in got] == [None, None, ("C", "s", "m"), None]


COLUMNS = "line_idx long, uri string, has_ref boolean, stage string, verb string, username string, resource string, subresource string, namespace string, name string"


def test_noise_rules_and_modes(spark):
    ok = ("/api/v1/x", True, "ResponseComplete")
    rows = [
        (1, "/readyz", True, "ResponseComplete", "get", "u", "pods", None, None, None),
        (2, None, True, "ResponseComplete", "get", "u", "pods", None, None, None),
        (3, "/api/v1/x", True, "ResponseStarted", "watch", "u", "pods", None, None, None),
        (4, *ok, "get", "u", "pods", None, "falco", None),
        (5, *ok, "watch", rules.APISERVER, "roles", None, None, None),
        (6, *ok, "watch", rules.KCM, "certificatesigningrequests", None, None, None),
        (7, *ok, "get", "system:node:a", "nodes", None, None, None),
        (8, *ok, "create", rules.KCM, "serviceaccounts", None, "kube-system", "generic-garbage-collector"),
        (9, *ok, "get", None, "pods", None, "a", None),
        (10, "/api?timeout=1", True, "ResponseComplete", "get", "u", "pods", None, None, None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.line_idx: r.d for r in df.select("line_idx", rules.noise_decision().alias("d")).collect()}
    assert [got[i] for i in range(1, 11)] == ["removed"] * 4 + ["blacklisted"] * 4 + ["whitelisted", "removed"]
    assert reduced(df, "labelling").count() == 10 and reduced(df, "light").count() == 5 and reduced(df).count() == 1
    assert reduced(df, "reduction", ("nodes_getting_their_own_status",)).count() == 2
    codes = {r.line_idx: r.c for r in df.select("line_idx", rules.control_plane_code().alias("c")).collect()}
    assert codes[5] == 2000 and codes[6] is None and codes[7] == 2012 and codes[8] == 2004


def test_anchored_windows_edges(spark):
    s = 1_000_000
    rows = [("a", 1, 0), ("a", 2, 300 * s), ("a", 3, 300 * s + 1), ("a", 4, 500 * s), ("a", 5, 700 * s), ("b", 6, 0)] + [("c", 10 + k, k) for k in range(1001)]
    df = spark.createDataFrame(rows, "label string, line_idx long, ts_us long")
    w = {r.line_idx: r.window_start for r in windows.anchored_windows(df, ["label"]).collect()}
    assert [w[i] for i in range(1, 7)] == [1, 1, 3, 3, 5, 6]
    assert w[1009] == 10 and w[1010] == 1010
    assert windows.anchored_windows(df.limit(0), ["label"]).count() == 0


def plain_windows(rows, limit, most):
    """line -> first line of its window, one row after the other."""
    out = {}
    for label in {r[0] for r in rows}:
        own, made, start = [r for r in rows if r[0] == label], [], None
        for _, i, t in own:
            if t is None:
                continue
            if start is not None and t - at <= limit and count < most:
                count += 1
                made[-1][1] = i
            else:
                start, at, count = i, t, 1
                made.append([i, i])
        out.update({i: a for _, i, _ in own for a, b in made if a <= i <= b})
    return out


@pytest.mark.parametrize("kind", ["steady", "gaps in time", "falling"])
def test_anchored_windows_across_ranges(spark, kind):
    r = np.random.default_rng(1)
    rows = []
    for label, n in (("hot", 300), ("some", 25), ("one", 1), ("few", 3)):  # the hot label is in every range
        t = r.integers(0, 3000, n) if kind == "falling" else np.cumsum(r.integers(0, 60, n))
        rows += [(label, 3 * len(rows) + 3 * k + 1, None if kind != "steady" and r.random() < 0.25 else int(t[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "label string, line_idx long, ts_us long").repartition(3)
    got = windows.anchored_windows(df, ["label"], limit_us=200, most=7)
    assert {x.line_idx: x.window_start for x in got.collect()} == plain_windows(rows, 200, 7)


def test_numbers_chunks_and_sums(spark):
    df = spark.range(5000).selectExpr("id * 3 AS line_idx", "id % 3 AS g", "id % 7 AS v")
    assert windows.numbered(df, ["g"], ["line_idx"]).filter("i <> (line_idx DIV 3) DIV 3").count() == 0
    rows, w, own = windows.in_chunks(df, ["g"], ["line_idx"], behind=2, ahead=3, size=100)
    got = rows.withColumns({"a": F.lag("line_idx", 2).over(w), "b": F.lead("line_idx", 3).over(w)}).filter(own)
    plain = Window.partitionBy("g").orderBy("line_idx")
    want = df.withColumns({"a": F.lag("line_idx", 2).over(plain), "b": F.lead("line_idx", 3).over(plain)})
    assert sorted(map(tuple, got.select("line_idx", "a", "b").collect()), key=str) == sorted(map(tuple, want.select("line_idx", "a", "b").collect()), key=str)
    summed = windows.running(got, ["g"], "v", "total").select("line_idx", "total")
    assert summed.join(df.withColumn("want", F.sum("v").over(plain)), "line_idx").filter("total <> want").count() == 0


def test_numbers_beside_columns_of_any_name(spark):
    df = spark.range(200).selectExpr("id AS line_idx", "id % 3 AS _part", "id AS _local", "id AS _p", "id AS _before", "id AS _k0", "id % 2 AS n_")
    got = windows.numbered(df, ["n_"], ["line_idx"])
    assert got.columns == [*df.columns, "i"] and got.filter("i <> line_idx DIV 2 OR _part <> line_idx % 3 OR _before <> line_idx").count() == 0


@pytest.mark.parametrize("n", [1000, 4000])
def test_ranges_do_not_grow_with_the_log(spark, monkeypatch, n):
    """However many rows a key has, no task takes more than about so many of them."""
    monkeypatch.setattr(windows, "RANGE_ROWS", 100)
    df = spark.range(n).selectExpr("id AS line_idx", "'hot' AS label", "id * 7 AS ts_us")
    sizes = [r["count"] for r in windows.ranged(df, ["label"], ["line_idx"]).groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 200
    assert windows.numbered(df, [], ["line_idx"]).filter("i <> line_idx").count() == 0
    got = windows.anchored_windows(df, ["label"], limit_us=50, most=1000)
    assert got.count() == n and got.filter("window_start <> line_idx - line_idx % 8").count() == 0


def test_compaction(spark):
    s = 1_000_000
    df = spark.createDataFrame([(k, t * s) for k, t in enumerate([0, 299, 599, 900, 1800])], "line_idx long, ts_us long")
    assert [r.shift_us // s for r in windows.compacted(df).orderBy("line_idx").collect()] == [0, 0, 0, 241, 241 + 840]


def test_vote_ties_and_boundaries(spark):
    rows = [(i, j, (i + j) % 2) for i in range(5) for j in range(3)]
    p = spark.createDataFrame(rows, "window_idx long, offset int, label int")
    got = {r.k: r.predicted for r in sequence.weighted_vote(p, 3).collect()}
    assert got == {0: -3, 1: -3, 2: 0, 3: 1, 4: 0, 5: -3, 6: -3}
    tie = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], "window_idx long, offset int, label int")
    assert sequence.weighted_vote(tie, 2).filter("k = 1").first().predicted == 5


def row(i, ts, trigger=False, **more):
    base = {"line_idx": i, "ts_us": ts, "trigger": trigger, "cp": None, "username": None, "verb": None, "resource": None, "namespace": None, "name": None, "uid": None, "owner_uids": [], "involved": None, "claim": None}
    return base | more


def test_scores_and_ties():
    a = row(1, 0, True, username="u", verb="get", resource="pods", namespace="n", name="p", uid="1")
    got = clustering.assign([a, row(2, 1, username="u", verb="get", resource="q"), row(3, 1, username="u", resource="r"), row(4, 1, resource="pods", namespace="n", name="p"), row(5, 1, resource="s", owner_uids=["1"]), row(6, 1, resource="t", involved=("Pod", "n", "p", "pods"))])
    assert got == {1: "1", 2: "1", 3: "3", 4: "1", 5: "1", 6: "1"}
    near = clustering.assign([row(1, 0, True, username="u", verb="get"), row(2, 100, True, username="u", verb="get"), row(3, 90, username="u", verb="get"), row(4, 50, username="u", verb="get")])
    assert near[3] == "2" and near[4] == "1"
    life = clustering.assign([row(1, 0, True, username="bob", verb="create", resource="namespaces", name="x"), row(2, 1, username="system:apiserver", verb="list", resource="limitranges", namespace="x")])
    assert life[2] == "1"
    gone = clustering.assign([row(1, 0, True, username="bob", verb="delete", resource="namespaces", name="x"), row(2, 1, username="system:c", verb="deletecollection", resource="pods", namespace="x")])
    assert gone[2] == "1"
    assert clustering.assign([row(1, 0, cp=2000), row(2, 0, cp=2001)], merge=True) == {1: "2020", 2: "2020"}
    assert clustering.assign([row(1, 0, True, cp=2000), row(2, 0, True, cp=2001), row(3, 0, cp=2002)], merge=True) == {1: "2020", 2: "2020", 3: "2020"}
    assert clustering.assign([row(1, 0, True, cp=2000, resource="a"), row(2, 0, cp=2001, resource="b")]) == {1: "1", 2: "2"}
    assert clustering.assign([row(1, 0, True), row(2, 5)]) == {1: "1", 2: "1"}  # what names nothing matches what names nothing
    # Two control-plane triggers: the second is the anchor and gives the verb; a like record at that time joins them.
    two = [row(1, 0, True, cp=1, verb="get", username="n"), row(2, 100, True, cp=1, verb="watch", username="n"), row(3, 90, username="n", verb="watch", resource="r")]
    assert clustering.assign(two, merge=True) == {1: "2020", 2: "2020", 3: "2020"}
    assert clustering.assign([*two[:2], row(3, 90, username="n", verb="get", resource="r")], merge=True)[3] == "3"


def plain_assign(rows, merge):
    """The same fold, with every record scored against every cluster."""
    seeds, clusters, out = {}, {}, {}
    for r in rows:
        if r["trigger"]:
            seeds["2020" if merge and r["cp"] is not None else str(r["line_idx"])] = r
    for r in [*seeds.values(), *rows]:
        if r["line_idx"] in out:
            continue
        if merge and r["cp"] is not None:
            name = "2020"
        elif any(r is x for x in seeds.values()):
            name = str(r["line_idx"])
        else:
            scored = [(c.score(r), c) for c in clusters.values() if c.anchor is not None]
            best = max((s for s, _ in scored), default=0)
            ties = [c for s, c in scored if s == best and s >= clustering.LEAST]
            name = str(r["line_idx"]) if not ties else (ties[0] if r["ts_us"] is None else min(ties, key=lambda c: abs(r["ts_us"] - c.anchor))).first
        clusters.setdefault(name, clustering.Cluster(name, r)).take(r)
        out[r["line_idx"]] = name
    return out


def random_window(seed, n, values):
    r = np.random.default_rng(seed)
    pick = lambda *v: v[int(r.integers(len(v)))]
    out = []
    for i in range(n):
        a, b = (pick("", None, *"abcdefgh"[:values]) for _ in range(2))
        out.append(row(i, pick(i * 10, i * 10, i // 3, None), bool(r.random() < 0.2), cp=pick(None, None, None, 2001), username=pick("system:apiserver", "bob", "eve", "", None), verb=pick("create", "delete", "get", "list", "deletecollection", None), resource=pick("namespaces", "limitranges", "pods", None), namespace=a, name=b, uid=pick(None, None, a), owner_uids=pick([], [], [b], [a, b]), involved=pick(None, None, ("Pod", a, b, "pods"), ("Pod", a, None, "namespaces")), claim=pick(None, None, None, ("C", a, b), ("C", a, None))))
    return out


@pytest.mark.parametrize("merge", [False, True])
def test_index_gives_the_clusters_of_all_comparisons(merge):
    for seed in range(150):
        window = random_window(seed, 40 + seed % 60, 1 + seed % 8)
        assert clustering.assign(window, merge) == plain_assign(window, merge), seed


def test_index_compares_few(monkeypatch):
    """Records that share user and verb alone, or nothing: scores are taken for a few clusters a record, not for all."""
    calls, score = [0], clustering.Cluster.score
    monkeypatch.setattr(clustering.Cluster, "score", lambda self, r: calls.__setitem__(0, calls[0] + 1) or score(self, r))
    for rows in ([row(i, i, username=f"u{i}", verb="get", resource="pods", name=f"p{i}") for i in range(1000)], [row(i, i, i % 2 == 0, username="u", verb="get", resource="pods", name=f"p{i}") for i in range(1000)]):
        calls[0] = 0
        clustering.assign(rows)
        assert calls[0] <= 2000


def test_pairwise_scores_are_those_of_clusters(spark):
    r = np.random.default_rng(7)
    pick = lambda *v: v[int(r.integers(len(v)))]
    kinds = "line_idx long, ts_us long, username string, verb string, resource string, namespace string, name string, uid string, owner_uids array<string>, involved struct<kind:string,namespace:string,name:string,resource:string>, claim struct<kind:string,namespace:string,name:string>"
    rows = []
    for i in range(60):
        rows.append((i, i, pick("system:apiserver", "bob", "", None), pick("create", "delete", "get", "list", "deletecollection", None), pick("namespaces", "limitranges", "pods", None), pick("a", "b", "", None), pick("a", "b", "", None), pick("u", "v", None), pick(["u"], ["v", "u"], []), pick(None, ("Pod", "a", "b", "pods"), ("Pod", None, None, "namespaces")), pick(None, ("C", "a", "b"), ("C", "a", None))))
    df = spark.createDataFrame(rows, kinds)
    seeds = df.select(*[F.col(c).alias(f"s_{c}") for c in df.columns])
    got = {(x.line_idx, x.s_line_idx): x.score for x in df.crossJoin(seeds).select("line_idx", "s_line_idx", clustering.match_score().alias("score")).collect()}
    names = df.columns
    as_row = lambda t: row(*t[:2], **dict(zip(names[2:], t[2:])))
    for t in rows:
        for u in rows:
            c = clustering.Cluster("x", as_row(u))
            c.take(as_row(u))
            assert got[t[0], u[0]] == c.score(as_row(t)), (t, u)
    assert len(set(got.values())) > 20


def reference_clusters(rows, merge, limit, most):
    """line -> cluster of records (dicts by line), label by label and window by window: the rules once more, without Spark."""
    out, by = {}, {}
    for r in rows:
        if r["label"] is not None:
            by.setdefault(r["label"], []).append(r)
    for own in by.values():
        alone = lambda r: "2020" if merge and r["cp"] is not None else str(r["line_idx"])
        if len(own) == 1 or all(r["trigger"] for r in own):
            out.update({r["line_idx"]: alone(r) for r in own})
            continue
        start = plain_windows([("x", r["line_idx"], r["ts_us"]) for r in own], limit, most)
        for first in sorted(set(start.values())):
            window = [r for r in own if start.get(r["line_idx"]) == first]
            out.update({window[0]["line_idx"]: alone(window[0])} if len(window) == 1 else clustering.assign(window, merge))
        out.update({r["line_idx"]: None for r in own if r["line_idx"] not in start})
    return out


@pytest.mark.parametrize("merge", [False, True])
def test_clusters_of_a_json_log(spark, tmp_path, merge):
    """A log as it is written, through reader, labels, windows, scorer and heartbeat repair."""
    r = np.random.default_rng(3)
    pick = lambda *v: v[int(r.integers(len(v)))]
    log, at = [], 0
    for i in range(160):
        at += int(r.integers(1, 90))
        user = pick("bob", "system:apiserver", "system:node:w1", "system:kube-controller-manager")
        node = user == "system:node:w1"
        verb, resource = pick(("get", "nodes"), ("patch", "nodes"), ("update", "leases")) if node else pick(("create", "namespaces"), ("get", "pods"), ("list", "limitranges"), ("watch", "pods"), ("delete", "namespaces"))
        ref = {"resource": resource, "apiVersion": "v1"} | ({"apiGroup": "coordination.k8s.io", "namespace": "kube-node-lease"} if resource == "leases" else {"namespace": pick("a", "b")} if resource in ("pods", "limitranges") else {})
        ref |= {"name": "w1"} if node else {"name": pick("a", "b")} if verb in ("create", "get", "delete") else {}
        line = {"verb": verb, "stage": "ResponseComplete", "requestURI": "/apis/x/y/z" if resource == "leases" else "/api/v1/x", "user": {"username": user}, "objectRef": ref, "responseObject": {"metadata": pick({"uid": "1"}, {"ownerReferences": [{"uid": "1"}]}, {})}}
        if i % 13:
            line["requestReceivedTimestamp"] = f"2024-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}.000000Z"
        if i % 17:
            line["label"] = pick(17808, 61632, 4496, 4528)
        log.append(line)
    path = lines(tmp_path, log)
    records = clustering.with_optional(labels.propose(audit.read_audit_jsonl(spark, path)))
    told = records.withColumns({"trigger": clustering.is_trigger(), "cp": rules.control_plane_code()}).orderBy("line_idx").collect()
    # Some records carry the label that their request proposes: they are triggers.
    again = [x | ({"label": t.proposal} if "label" in x and k % 3 == 0 and t.proposal >= 0 else {}) for k, (x, t) in enumerate(zip(log, told))]
    records = stored(spark, audit.read_audit_jsonl(spark, lines(tmp_path, again)), "log")
    told = clustering.with_optional(labels.propose(records)).withColumns({"trigger": clustering.is_trigger(), "cp": rules.control_plane_code()}).orderBy("line_idx").collect()
    rows = [x.asDict() | {"owner_uids": list(x.owner_uids), "involved": x.involved and tuple(x.involved), "claim": x.claim and tuple(x.claim)} for x in told]
    want = reference_clusters(rows, merge, windows.LIMIT_US, windows.MOST_ROWS)
    got = {x.line_idx: x.cluster_id for x in clustering.clustered(labels.propose(records), merge).collect()}

    def partition(of):
        groups = {}
        for i, c in of.items():
            groups.setdefault(c, set()).add(i)
        return {frozenset(g) for c, g in groups.items() if c is not None}, frozenset(groups.get(None, ()))

    assert sum(x.trigger for x in told) > 10 and len(set(want.values())) < len(want) and partition(got) == partition(want)
    assert ({i for i, c in got.items() if c == "2020"} == {i for i, c in want.items() if c == "2020"}) and (not merge or "2020" in got.values())
    # Heartbeats: reads of the own node go where the nearest trigger of that node is.
    renewals = [(x.ts_us, x.line_idx, 0 if x.resource == "leases" else 1) for x in told if x.trigger and x.username == "system:node:w1" and x.name == "w1" and x.ts_us is not None and x.verb in ("update", "patch") and (x.resource == "nodes" or x.namespace == "kube-node-lease")]
    moved = dict(got)
    for x in told:
        if x.username == "system:node:w1" and x.verb == "get" and x.resource == "nodes" and x.name == "w1" and x.ts_us is not None and got.get(x.line_idx) is not None and renewals:
            t, i, _ = min(renewals, key=lambda c: (abs(c[0] - x.ts_us), c[0] < x.ts_us, c[2], c[1]))
            if abs(t - x.ts_us) <= 15_000_000:
                moved[x.line_idx] = got[i]
    assert {x.line_idx: x.cluster_id for x in clustering.cluster_log(records, merge).collect()} == moved
    table = clustering.cluster_table(clustering.cluster_log(records, merge), scalars.informative(records), most=5).collect()
    assert sorted(i for t in table for i in t.indices) == sorted(i for i, c in moved.items() if c is not None) and max(len(t.indices) for t in table) <= 5 and all(len(t.lines) == len(t.indices) for t in table)


def test_relabelling(spark):
    columns = "line_idx long, has_ref boolean, has_namespace_key boolean, username string, user_groups string, verb string, resource string, subresource string, namespace string, name string, legacy_token boolean, proposal int, label int, cplabel boolean"
    node = (True, True, "system:node:a", ",system:nodes,", "get", "nodes", None, None, "a", False, 61616)
    crd = (True, False, "bob", ",,", "get", "widgets", None, None, None, False, 666 * 4096)
    none = (True, True, "bob", ",,", "get", "pods", None, "x", None, False, 4400)
    rows = [(1, *node, None, None), (2, *node, 5, None), (3, *crd, None, None), (4, *none, 7, None), (5, *none, None, True), (6, *node, 61632, None), (7, False, *node[1:], None, None)]
    df = spark.createDataFrame(rows, columns)
    for force, second in ((False, 5), (True, 61632)):
        got = {r.line_idx: (r.new_label, r.new_cplabel) for r in rules.relabelled(df, force=force).collect()}
        assert got == {1: (61632, True), 2: (second, True), 3: (666 * 4096, True), 4: (7, None), 5: (-1, True), 6: (61632, True), 7: (-1, None)}


def test_detection_rules(spark, tmp_path):
    def event(verb="create", resource="pods", code=201, user="bob", stage="ResponseComplete", uri="/api/v1/x", request=None, decision="allow", **ref):
        return {"verb": verb, "stage": stage, "requestURI": uri, "user": {"username": user}, "objectRef": {"resource": resource, "apiVersion": "v1"} | ref, "responseStatus": {"code": code}, "annotations": {"authorization.k8s.io/decision": decision}} | ({"requestObject": request} if request else {})

    def pod(image="evil", **more):
        return {"spec": {"containers": [{"image": image} | more.pop("container", {})], **more}}

    admin = {"user": "admin"}
    trusted = "docker.io/calico/node:v3@sha256:1"
    cases = [
        (event(verb="list"), {"Disallowed K8s User"}),
        (event(verb="list", stage="ResponseStarted"), set()),
        (event(verb="list", user="system:x"), set()),
        (event(verb="list", user="eks:nodewatcher"), set()),
        (event(**admin, request=pod(container={"securityContext": {"privileged": True}})), {"Create Privileged Pod"}),
        (event(**admin, request=pod(trusted, container={"securityContext": {"privileged": True}})), set()),
        (event(**admin, request=pod("localhost:5000/falcosecurity/falco:1", container={"securityContext": {"privileged": True}})), {"Create Privileged Pod"}),
        (event(**admin, request=pod(container={"securityContext": {"privileged": False}})), set()),
        (event(**admin, subresource="exec", request=pod(container={"securityContext": {"privileged": True}})), set()),
        (event(**admin, request=pod(volumes=[{"name": "x"}, {"hostPath": {"path": "/etc"}}])), {"Create Sensitive Mount Pod"}),
        (event(**admin, request=pod(trusted, volumes=[{"hostPath": {"path": "/etc"}}])), set()),
        (event(**admin, request=pod(volumes=[{"hostPath": {"path": "/data"}}])), set()),
        (event(**admin, request=pod(hostNetwork=True)), {"Create HostNetwork Pod"}),
        (event(**admin, request=pod("gke.gcr.io/kube-proxy", hostNetwork=True)), set()),
        (event(**admin, request=pod(hostPID=True, hostIPC=True)), {"Create HostPid Pod", "Create HostIPC Pod"}),
        (event(**admin, resource="services", request={"spec": {"type": "NodePort"}}), {"Create NodePort Service", "K8s Service Created"}),
        (event(**admin, resource="configmaps", verb="patch", request={"data": {"a": "my password: x"}}), {"Create/Modify Configmap With Private Credentials"}),
        (event(**admin, resource="configmaps", verb="patch", request={"data": {"a": "nothing"}}), set()),
        (event(user="system:anonymous", verb="get", uri="/api/v1/pods"), {"Anonymous Request Allowed"}),
        (event(user="system:anonymous", verb="get", uri="/healthz?timeout=1"), set()),
        (event(user="system:anonymous", verb="get", uri="/healthzz"), {"Anonymous Request Allowed"}),
        (event(user="system:anonymous", verb="get", decision="forbid"), set()),
        (event(**admin, stage="ResponseStarted", subresource="attach"), {"Attach/Exec Pod"}),
        (event(**admin, subresource="exec"), set()),
        (event(**admin, verb="get", stage="ResponseStarted", subresource="portforward"), {"port-forward"}),
        (event(**admin, verb="create", subresource="ephemeralcontainers"), {"EphemeralContainers Created"}),
        (event(**admin, resource="namespaces", name="mine"), {"Create Disallowed Namespace", "K8s Namespace Created"}),
        (event(**admin, resource="namespaces", name="default"), {"K8s Namespace Created"}),
        (event(**admin, namespace="kube-system", request=pod()), {"Pod Created in Kube Namespace"}),
        (event(**admin, namespace="kube-system", request=pod("registry.k8s.io/kube-apiserver:v1")), set()),
        (event(**admin, resource="serviceaccounts", namespace="kube-public", name="x"), {"Service Account Created in Kube Namespace", "K8s Serviceaccount Created"}),
        (event(**admin, resource="serviceaccounts", namespace="kube-public", name="coredns"), {"K8s Serviceaccount Created"}),
        (event(**admin, resource="serviceaccounts", namespace="kube-public", name="x", code=403), set()),
        (event(**admin, resource="clusterroles", verb="create", name="system:x", code=500), {"System ClusterRole Modified/Deleted"}),
        (event(**admin, resource="roles", verb="delete", name="system:coredns"), {"K8s Role Deleted"}),
        (event(**admin, resource="clusterrolebindings", request={"roleRef": {"name": "cluster-admin"}}), {"Attach to cluster-admin Role", "K8s ClusterRoleBinding Created"}),
        (event(**admin, resource="roles", request={"rules": [{"resources": ["pods/exec"], "verbs": ["get"]}, {"verbs": ["*"]}]}), {"ClusterRole With Wildcard Created", "ClusterRole With Pod Exec Created", "K8s Role Created"}),
        (event(**admin, resource="clusterroles", request={"rules": [{"resources": ["pods"], "verbs": ["deletecollection"]}]}), {"ClusterRole With Write Privileges Created", "K8s ClusterRole Created"}),
        (event(user="system:x", resource="namespaces", verb="delete", code=200), set()),
        (event(**admin, resource="namespaces", verb="delete", code=200), {"K8s Namespace Deleted"}),
        (event(**admin, resource="secrets", namespace="a"), {"K8s Secret Created"}),
        (event(**admin, resource="secrets", namespace="kube-system"), set()),
        (event(user="system:x", resource="secrets", namespace="a", verb="delete", code=200), set()),
        (event(**admin, resource="secrets", verb="get", code=200), {"K8s Secret Get Successfully"}),
        (event(**admin, resource="secrets", verb="get", code=302), {"K8s Secret Get Unsuccessfully Tried"}),
        (event(**admin, resource="ingresses", request={"spec": {"rules": []}}), {"Ingress Object without TLS Certificate Created"}),
        (event(**admin, resource="ingresses", request={"spec": {"tls": []}}), set()),
        (event(**admin, resource="nodes", name="n"), set()),
        (event(**admin, resource="deployments", code=404), set()),
    ]
    df = rules.with_spec(audit.read_audit_jsonl(spark, lines(tmp_path, [e for e, _ in cases])))
    every = rules.detection_rules()
    assert len(every) == 48 and len({n for n, _ in every}) == 48
    got = [set(r.d) for r in df.orderBy("line_idx").select(rules.detected(every).alias("d")).collect()]
    assert [(e, w, g) for (e, w), g in zip(cases, got) if w != g] == []
    on = dict(rules.detection_rules(allowed_images=("ok",), admins_allowed=False, allowed_nodes=("known",), all_events=True))
    told = [set(r.d) for r in df.orderBy("line_idx").select(rules.detected(list(on.items())).alias("d")).collect()]
    assert all(("All K8s Audit Events" in t) == (e["stage"] == "ResponseComplete") for (e, _), t in zip(cases, told))
    assert "Full K8s Administrative Access" in told[4] and "Create Disallowed Pod" in told[4] and "Untrusted Node Successfully Joined the Cluster" in told[-2]


def test_log_parts(spark, tmp_path):
    path = lines(tmp_path, ['rbs":"get"}', {"verb": "get"}, "[1]", "12", {"verb": "list"}])
    got = audit.cut_log(spark.read.text(path))
    assert [json.loads(r.value)["verb"] for r in got.collect()] == ["get", "list"]
    log = ["STATISTICS_ATTEMPTS: 5", *["Accuracy on labeled: 0.9 (errors: 1 / 10)"] * 4, "other", "Accuracy on labeled: 0.5 (errors)", "", "STATISTICS_ATTEMPTS: 2", "Accuracy on labeled: 0.1 (x)", " ", *["Accuracy on labeled: 1.0 (x)"] * 11]
    df = spark.createDataFrame(list(enumerate(log)), "line_idx long, line string")
    assert [(r.attempts, r.trials, round(r["mean"], 6)) for r in metrics.kfold_runs(df).collect()] == [(5, 5, 0.82)]


def test_ablation(spark):
    names = [f"f[{k}]" for k in range(13)]
    rows = [(k, [n for n in names if n != f"f[{k}]"], float(k)) for k in range(13)] + [(13, names, 50.0), (13, names, 52.0)]
    df = spark.createDataFrame(rows, "run int, features array<string>, precision double")
    got = {r.feature: r.value for r in metrics.ablation(df).collect()}
    assert got == {**{f"f{k}": float(k) for k in (12, 11, 10, 9, 8, 0, 1, 2, 3, 4)}, "All features": 51.0, "Average": 3.5}


def test_vote_errors(spark):
    ok, other, third = 61632, 61616, 17808
    votes = [(w, j, x) for w, labels_ in enumerate([[ok, ok, ok], [ok, other, ok], [ok, ok, ok], [third, 5, ok], [ok, ok, ok]]) for j, x in enumerate(labels_)]
    p = spark.createDataFrame(votes, "window_idx long, offset int, label int")
    told = {r.k: r.predicted for r in sequence.weighted_vote(p, 3).collect()}
    truth = spark.createDataFrame([(2, other), (3, ok), (4, third), (1, ok), (0, -1), (5, None)], "line long, true_label int")
    got = {r.line: (r.predicted, r.correct, r.bucket) for r in sequence.vote_errors(p, truth, 3).collect()}
    assert got.keys() == {2, 3, 4}
    for line, (predicted, correct, bucket) in got.items():
        t = {2: other, 3: ok, 4: third}[line]
        options = {x for w, j, x in votes if w + j == line}
        assert predicted == told[line] and correct == (t == predicted)
        assert bucket == (None if correct or 5 in (t, predicted) else "one, not in it" if len(options) == 1 else "many, in it" if t in options else "many, not in it")


def test_bundle_round_trip(spark, tmp_path):
    rows = [(k, "e", ["get", "list"][k % 2], ["pods", "nodes"][k // 2 % 2], [4400, 61616][k // 2 % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "line_idx long, event_type string, verb string, resource string, label int")
    made = sequence.train_bundle(df, ["verb", "resource"], ["event_type"])
    want = {r.line_idx: r.predicted for r in made.infer(df).collect()}
    assert want == {r[0]: r[4] for r in rows}
    made.save(str(tmp_path / "bundle"))
    unseen = df.unionByName(spark.createDataFrame([(60, "e", "new", "pods", None)], df.schema))
    got = {r.line_idx: r.predicted for r in sequence.Bundle.load(spark, str(tmp_path / "bundle")).infer(unseen).collect()}
    assert len(got) == 61 and all(got[i] == x for i, x in want.items() if i < 59)


def test_nearest_ties_and_tolerance(spark):
    s = 1_000_000
    rows = spark.createDataFrame([("n", 1, 100 * s), ("m", 2, 100 * s), ("o", 3, 100 * s)], "node string, line_idx long, ts_us long")
    others = spark.createDataFrame([("n", 11, 97 * s, 0), ("n", 12, 103 * s, 1), ("n", 13, 103 * s, 0), ("m", 14, 85 * s, 0), ("o", 15, 115 * s + 1, 0)], "node string, line_idx long, ts_us long, priority int")
    assert {r.line_idx: r.other_idx for r in clustering.nearest(rows, others, "node").collect()} == {1: 13, 2: 14}


def test_compare_clusterings(spark):
    gt = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (6, "d"), (7, "e"), (8, "e"), (9, "f")], "line_idx long, cluster string")
    pred = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C"), (6, "D"), (7, "E"), (8, "F"), (9, "F")], "line_idx long, cluster string")
    got = {r.gt: r.category for r in metrics.compare_clusterings(gt, pred).collect()}
    assert got == {"a": "perfect", "b": "merge", "c": "merge", "d": "split", "e": "split_and_merge", "f": "merge"}


def test_kappa_of_one_class(spark):
    same = spark.createDataFrame([(1, 1), (1, 1)], "actual int, predicted int")
    assert metrics.kappa(same).first().kappa == 1.0


def test_scratch_tables_go(spark):
    with scratch(spark) as outer:
        a = stored(spark, spark.range(3), "kept")
        with scratch(spark) as tables:
            stored(spark, a, "gone")
            b = stored(spark, a, "kept")
            gone, kept = tables[0], tables.pop()
        assert outer[1:] == [gone, kept] and b.count() == 3 and a.count() == 3
        del outer[0], outer[1]
    stored(spark, b, "after")
    assert outer == [gone] and a.union(b).count() == 6
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(gone)


def test_sweep_deletes_what_was_stored(spark, monkeypatch):
    from tracewright import session

    monkeypatch.setattr(session, "_every", [])
    a = stored(spark, spark.range(3).toDF("line_idx"), "a")
    monkeypatch.setattr(session, "_every", [*session._every, ("another application", "/nowhere")])
    assert a.count() == 3 and session.sweep(spark) == 1 and session._every == [("another application", "/nowhere")]
    with pytest.raises(Exception, match="(?i)not.exist"):
        a.count()


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_matches_batch(spark):
    from tracewright.streaming import sessions

    sf = "/root/testdata/sf0.001"
    got = {(r.event_type, r.start, r.n) for r in sessions.replayed(spark, f"{sf}/events.parquet").collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    w = Window.partitionBy("event_type").orderBy("ts")
    opens = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 300_000_000).cast("int"), F.lit(1))
    runs = events.withColumn("o", opens).withColumn("s", F.sum("o").over(w)).groupBy("event_type", "s").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    top = events.agg(F.max("ts")).first()[0]
    closed = {(r.event_type, r.start, r.n) for r in runs.collect() if (top - r["last"]).total_seconds() > 600}
    every = {(r.event_type, r.start, r.n) for r in runs.collect()}
    assert closed <= got <= every and len(closed) > 100


def test_levels_are_gone_down_in_one_pass(spark, tmp_path, monkeypatch):
    kept, passes = scalars.stored, []
    monkeypatch.setattr(scalars, "stored", lambda *a: passes.append(1) or kept(*a))
    rows = ['{"a":{"b":[1,null,{"c":"x"},[],{}]},"e":{},"n":null,"t":true}', '[{"z":[[2]]}]', "7", "[]"]
    raw = spark.createDataFrame(list(enumerate(rows)), "line_idx long, value string").select("line_idx", F.parse_json("value").alias("raw"))
    want = {(0, "a.b[0]", "1"), (0, "a.b[1]", None), (0, "a.b[2].c", "x"), (0, "n", None), (0, "t", "true"), (1, "[0].z[0][0]", "2"), (2, "", "7")}
    for levels, n in ((scalars.LEVELS, 1), (2, 2), (1, 4)):
        passes.clear()
        got = [tuple(r) for r in scalars.flattened(raw, levels).collect()]
        assert set(got) == want and len(got) == len(want) and len(passes) == n


def test_modes_are_told_in_one_pass(spark):
    from tracewright.plans.reduce import MODES, reduced, tally

    columns = "line_idx long, uri string, has_ref boolean, stage string, verb string, resource string, subresource string, namespace string, name string, username string"
    rows = [(k, "/api/v1/pods", True, "ResponseComplete", ["watch", "get", "list"][k % 3], ["pods", "nodes"][k % 2], None, ["falco", "web", None, "web", None][k % 5], None, ["system:apiserver", "alice"][k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, columns)
    for part in (df, df.filter("line_idx < 0")):
        told = tally(part, "line_idx")
        want = {(m, *reduced(part, m).agg(F.count("*"), F.sum("line_idx")).first()) for m in MODES}
        assert {tuple(r) for r in told.collect()} == want
        assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
