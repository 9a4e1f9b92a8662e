"""Clusters of related records: trivial cases by window functions, the order-dependent rest by a fold per time window."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, rules
from ..session import ship, stored
from ..sources.audit import optional
from . import windows

# What a match is worth, and the least that joins a cluster.
USER, VERB, RESOURCE, OWNED, OWNER, INVOLVED, INVOLVED_RESOURCE, CLAIM, CLAIM_RESOURCE, LIMITS, NAMESPACE_GONE = 30, 30, 100, 80, 80, 60, 70, 60, 60, 90, 95
LEAST = 60
CONTROL_PLANE = "2020"
NEAR_US = 15_000_000
#: Records of a cluster that a row of cluster_table() holds at most.
MOST_LINES = 10_000


def is_trigger() -> Column:
    """A labelled record that its own request explains."""
    return F.coalesce((F.col("label") >= 0) & (F.col("label") == F.col("proposal")), F.lit(False))


def trivial(records: DataFrame) -> DataFrame:
    """Adds case: `single` and `triggers` give a cluster a row, `fold` needs the scorer. Wants label, trigger."""
    sizes = records.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.count_if("trigger").alias("_t"))
    told = sizes.select("label", F.when(F.col("_n") == 1, "single").when(F.col("_t") == F.col("_n"), "triggers").otherwise("fold").alias("case"))
    return records.join(told, "label")


def cluster_id(first) -> Column:
    """A name that only depends on the cluster's first record."""
    return F.substring(F.sha2(first.cast("string"), 256), 1, 32)


class Cluster:
    def __init__(self, first: str, row: dict, order: int = 0):
        self.first, self.anchor, self.order = first, row["ts_us"], order
        self.users, self.verbs = set(), {row["verb"]} - {None, ""}
        self.resources, self.uids, self.owners, self.involved, self.claims = set(), set(), set(), set(), set()

    def take(self, r) -> None:
        if r["username"]:
            self.users.add(r["username"])
        self.resources.update(places(r))
        if r["uid"]:
            self.uids.add(r["uid"])
        self.owners.update(r["owner_uids"])
        if r["involved"]:
            self.involved.add(r["involved"])
        if r["claim"]:
            self.claims.add(r["claim"])

    def score(self, r) -> int:
        s = USER * (bool(r["username"]) and r["username"] in self.users) + VERB * (bool(r["verb"]) and r["verb"] in self.verbs)
        s += RESOURCE * ((r["resource"], r["namespace"], r["name"]) in self.resources)
        s += OWNED * (bool(r["uid"]) and r["uid"] in self.owners) + OWNER * bool(self.uids.intersection(r["owner_uids"]))
        if i := r["involved"]:
            s += INVOLVED * (i in self.involved) + INVOLVED_RESOURCE * ((i[3], i[1], i[2]) in self.resources)
        if c := r["claim"]:
            s += CLAIM * (c in self.claims) + CLAIM_RESOURCE * any(c[1] == ns and c[2] == n for _, ns, n in self.resources)
        if asks_limits(r):
            s += LIMITS * (any(not u.startswith("system:") for u in self.users) and any(ns == r["namespace"] for _, ns, _ in self.resources))
        if after_namespace(r):
            s += NAMESPACE_GONE * (("namespaces", r["namespace"], None) in self.resources)
        return s


def places(r) -> list[tuple]:
    """The resources that a record brings into a cluster."""
    out = [(r["resource"], r["namespace"], r["name"])]
    if r["resource"] == "namespaces" and r["name"]:
        if r["verb"] == "create":
            out.append(("limitranges", r["name"], None))
        elif r["verb"] == "delete":
            out.append(("namespaces", r["name"], None))
    return out


def asks_limits(r) -> bool:
    return bool(r["username"] == "system:apiserver" and r["verb"] == "list" and r["resource"] == "limitranges" and r["namespace"])


def after_namespace(r) -> bool:
    return bool(r["verb"] in ("deletecollection", "get") and r["namespace"] and r["resource"] != "namespaces")


class Index:
    """Clusters by what a record must share with them to join: any one of the keys of sought(), or user and verb together.

    A cluster that only shares user and verb with a record scores the same as every other of that kind, so of these the one that is
    nearest in time is enough; they are kept in order of time for each user and verb.
    """

    def __init__(self):
        self.by: dict[tuple, list[Cluster]] = {}
        self.known: set[tuple] = set()
        self.pairs: dict[tuple, list[tuple]] = {}
        self.first: dict[tuple, Cluster] = {}

    def add(self, c: Cluster, r) -> None:
        """What c has taken with r."""
        if c.anchor is None:  # no record joins it
            return
        keys = [("place", p) for p in places(r)] + [("named", p[1:]) for p in places(r)] + [("in", p[1]) for p in places(r)] + [("owner", x) for x in r["owner_uids"]]
        keys += [(k, r[f]) for k, f in (("uid", "uid"), ("involved", "involved"), ("claim", "claim")) if r[f]]
        for k in keys:
            if (c.order, k) not in self.known:
                self.known.add((c.order, k))
                self.by.setdefault(k, []).append(c)
        for verb in c.verbs if r["username"] else ():
            pair = (r["username"], verb)
            if (c.order, pair) not in self.known:
                self.known.add((c.order, pair))
                insort(self.pairs.setdefault(pair, []), (c.anchor, c.order, c), key=lambda x: x[:2])
                if pair not in self.first or c.order < self.first[pair].order:
                    self.first[pair] = c

    def sought(self, r) -> list[tuple]:
        keys = [("place", (r["resource"], r["namespace"], r["name"])), *(("uid", x) for x in r["owner_uids"])]
        if r["uid"]:
            keys.append(("owner", r["uid"]))
        if i := r["involved"]:
            keys += [("involved", i), ("place", (i[3], i[1], i[2]))]
        if c := r["claim"]:
            keys += [("claim", c), ("named", (c[1], c[2]))]
        if asks_limits(r):
            keys.append(("in", r["namespace"]))
        if after_namespace(r):
            keys.append(("place", ("namespaces", r["namespace"], None)))
        return keys

    def like(self, r) -> list[Cluster]:
        """Of the clusters with the record's user and verb the nearest ones, before and after it; the first of equally near ones."""
        pair = (r["username"], r["verb"])
        if not (r["username"] and r["verb"]) or pair not in self.pairs:
            return []
        if r["ts_us"] is None:
            return [self.first[pair]]
        rows = self.pairs[pair]
        at = bisect_left(rows, (r["ts_us"], -1), key=lambda x: x[:2])
        out = [rows[at][2]] if at < len(rows) else []
        if at:
            out.append(rows[bisect_left(rows, (rows[at - 1][0], -1), key=lambda x: x[:2])][2])
        return out

    def best(self, r) -> Cluster | None:
        """The cluster that the record joins: the best of at least LEAST, of these the nearest, of these the first."""
        found = {c.order: c for k in self.sought(r) for c in self.by.get(k, ())} | {c.order: c for c in self.like(r)}
        scored = [(c.score(r), c) for c in found.values()]
        most = max((s for s, _ in scored), default=0)
        if most < LEAST:
            return None
        t = r["ts_us"]
        return min((c for s, c in scored if s == most), key=lambda c: (0 if t is None else abs(t - c.anchor), c.order))


def assign(rows: list[dict], merge: bool = False) -> dict[int, str]:
    """line_idx -> first line of its cluster (or CONTROL_PLANE). Triggers seed clusters, the others join the best or found one.

    merge: control-plane records, triggers among them, share one cluster. Its anchor and verb are those of the last such
    trigger, as each takes the seed's place; the earlier ones then join in order like other records.
    """
    seeds: dict[str, dict] = {}
    for r in rows:
        if r["trigger"]:
            seeds[CONTROL_PLANE if merge and r["cp"] is not None else str(r["line_idx"])] = r
    clusters, index, out = {}, Index(), {}

    def take(name: str, r: dict) -> None:
        if name not in clusters:
            clusters[name] = Cluster(name, r, len(clusters))
        clusters[name].take(r)
        index.add(clusters[name], r)
        out[r["line_idx"]] = name

    for name, r in seeds.items():
        take(name, r)
    for r in rows:
        if r["line_idx"] in out:
            continue
        if merge and r["cp"] is not None:
            name = CONTROL_PLANE
        else:
            near = index.best(r)
            name = near.first if near else str(r["line_idx"])
        take(name, r)
    return out


def match_score(row: str = "", seed: str = "s_") -> Column:
    """What a record scores against a cluster of one record, by columns with these prefixes: the pairwise form of Cluster.score()."""

    def r(c):
        return F.col(row + c)

    def s(c):
        return F.col(seed + c)

    def when(points, *conditions):
        both = F.lit(True)
        for x in conditions:
            both = both & F.coalesce(x, F.lit(False))
        return F.when(both, points).otherwise(0)

    def same(x, y):
        return x.eqNullSafe(y)

    full = lambda c: F.coalesce(c != "", F.lit(False))
    named = full(s("name")) & same(s("resource"), F.lit("namespaces"))
    made, gone = named & same(s("verb"), F.lit("create")), named & same(s("verb"), F.lit("delete"))
    # The seed's places: its own and the one that stands for what follows a namespace's creation or deletion.
    extra = F.when(made, F.lit("limitranges")).when(gone, F.lit("namespaces"))

    def at(resource, namespace, name):
        own = same(s("resource"), resource) & same(s("namespace"), namespace) & same(s("name"), name)
        return own | (extra.isNotNull() & same(extra, resource) & same(s("name"), namespace) & name.isNull())

    def placed(namespace, name):
        return (same(s("namespace"), namespace) & same(s("name"), name)) | (extra.isNotNull() & same(s("name"), namespace) & name.isNull())

    inv, claim, s_inv, s_claim = r("involved"), r("claim"), s("involved"), s("claim")
    score = when(USER, full(r("username")), r("username") == s("username")) + when(VERB, full(r("verb")), r("verb") == s("verb"))
    score += when(RESOURCE, at(r("resource"), r("namespace"), r("name")))
    score += when(OWNED, full(r("uid")), F.array_contains(s("owner_uids"), r("uid"))) + when(OWNER, full(s("uid")), F.array_contains(r("owner_uids"), s("uid")))
    score += when(INVOLVED, inv.isNotNull(), inv == s_inv) + when(INVOLVED_RESOURCE, inv.isNotNull(), at(inv["resource"], inv["namespace"], inv["name"]))
    score += when(CLAIM, claim.isNotNull(), claim == s_claim) + when(CLAIM_RESOURCE, claim.isNotNull(), placed(claim["namespace"], claim["name"]))
    human = full(s("username")) & ~s("username").startswith("system:")
    inside = same(s("namespace"), r("namespace")) | (extra.isNotNull() & same(s("name"), r("namespace")))
    score += when(LIMITS, r("username") == "system:apiserver", r("verb") == "list", r("resource") == "limitranges", full(r("namespace")), human, inside)
    left = (same(s("resource"), F.lit("namespaces")) & same(s("namespace"), r("namespace")) & s("name").isNull()) | (gone & same(s("name"), r("namespace")))
    return score + when(NAMESPACE_GONE, r("verb").isin("deletecollection", "get"), full(r("namespace")), ~same(r("resource"), F.lit("namespaces")), left)


def seed_metadata(triggers: DataFrame) -> DataFrame:
    """Of each label the sizes of the seven sets that its triggers would seed clusters with: users, verbs, resources, uids, owners, involved and claims."""
    own = F.struct(F.coalesce("resource", F.lit("")).alias("r"), F.col("namespace").alias("ns"), F.col("name").alias("n"))
    named = F.col("name").isNotNull() & (F.col("name") != "") & (F.col("resource") == "namespaces")
    more = F.when(named & (F.col("verb") == "create"), F.lit("limitranges")).when(named & (F.col("verb") == "delete"), F.lit("namespaces"))
    extra = F.when(more.isNotNull(), F.struct(more.alias("r"), F.col("name").alias("ns"), F.lit(None).cast("string").alias("n")))
    lists = {"users": F.array("username"), "verbs": F.array("verb"), "resources": F.array(F.to_json(own), F.to_json(extra)), "uids": F.array("uid"), "owners": F.col("owner_uids"), "involved": F.array(F.to_json("involved")), "claims": F.array(F.to_json("claim"))}
    told = triggers.select("label", *[F.array_compact(v).alias(k) for k, v in lists.items()])

    def named(k: str):
        return F.transform(F.coalesce(k, F.array().cast("array<string>")), lambda v: F.struct(F.lit(k).alias("set"), v.alias("v")))

    each = told.select("label", F.explode(F.flatten(F.array(*map(named, lists)))).alias("x")).select("label", "x.set", "x.v").distinct()
    return each.groupBy(F.col("label").cast("long").alias("label")).agg(*[F.count_if(F.col("set") == k).alias(k) for k in lists])


OPTIONAL = {"uid": "string", "owner_uids": "array<string>", "involved": "struct<kind:string,namespace:string,name:string,resource:string>", "claim": "struct<kind:string,namespace:string,name:string>"}


#: What clustered() wants of a record.
WANTED = ("line_idx", "label", "proposal", "ts_us", "username", "verb", "resource", "namespace", "name", *OPTIONAL)


def with_optional(records: DataFrame) -> DataFrame:
    """The records with uid, owner_uids, involved and claim: from the payload where there is one, else null where they are missing."""
    if "raw" in records.columns:
        return optional(records)
    return records.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in records.columns})


def clustered(records: DataFrame, merge: bool = False, limit_us: int = windows.LIMIT_US, most: int = windows.MOST_ROWS) -> DataFrame:
    """line_idx, label, cluster_id of every labelled record. Wants ts_us, label, proposal and the record's columns.

    Most rows never reach Python: the trivial cases are an aggregate by label. The fold runs per (label, window),
    which holds at most `most` rows with a timestamp. A record without a timestamp belongs to the window that it
    stands in; between two windows it belongs to none and its cluster_id is null.
    """
    spark = records.sparkSession
    ship(spark)
    wanted = ["line_idx", "label", "ts_us", "trigger", "cp", "username", "verb", "resource", "namespace", "name", *OPTIONAL]
    marked = trivial(with_optional(records.filter(F.col("label").isNotNull()).withColumns({"trigger": is_trigger(), "cp": rules.control_plane_code()})))
    marked = stored(spark, marked.select(*wanted, "case"), "marked")
    merged = F.lit(merge) & F.col("cp").isNotNull()
    easy = marked.filter("case <> 'fold'").select("line_idx", "label", F.when(merged, CONTROL_PLANE).otherwise(F.col("line_idx").cast("string")).alias("first"))
    open_ = marked.filter("case = 'fold'")
    found = windows.anchored_windows(open_.select("line_idx", "label", "ts_us"), ["label"], limit_us=limit_us, most=most).drop("label")
    rest = open_.join(found, "line_idx", "left").select(*wanted, "window_start")
    schema = pa.schema([("line_idx", pa.int64()), ("label", pa.int32()), ("first", pa.string())])

    def assigned(window: list[dict]) -> list[tuple]:
        for r in window:
            r["owner_uids"] = r["owner_uids"] or []
            for c in ("involved", "claim"):
                r[c] = r[c] and tuple(r[c].values())
        return [(i, window[0]["label"], first) for i, first in assign(window, merge).items()]

    def fold(batches):  # rows come window by window; a window may go on in the next batch
        open_window: list[dict] = []
        for b in batches:
            out, rows = [], open_window + b.to_pylist()
            cuts = [0, *(k for k in range(1, len(rows)) if (rows[k]["label"], rows[k]["window_start"]) != (rows[k - 1]["label"], rows[k - 1]["window_start"]))]
            for x, y in zip(cuts, cuts[1:]):
                out += assigned(rows[x:y])
            open_window = rows[cuts[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)
        if open_window:
            out = assigned(open_window)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    by_window = rest.filter("window_start IS NOT NULL").repartition("label", "window_start").sortWithinPartitions("label", "window_start", "line_idx")
    hard = by_window.mapInArrow(fold, "line_idx long, label int, first string")
    outside = rest.filter("window_start IS NULL").select("line_idx", "label", F.lit(None).cast("string").alias("first"))
    every = easy.unionByName(hard).unionByName(outside)
    return every.select("line_idx", "label", F.when(F.col("first") == CONTROL_PLANE, CONTROL_PLANE).otherwise(cluster_id(F.col("first"))).alias("cluster_id"))


def cluster_table(assigned: DataFrame, informative: DataFrame | None = None, most: int = MOST_LINES) -> DataFrame:
    """One row per cluster: size, label of its first record, records in order and, given them, their informative lines (JSON).

    A cluster of more than `most` records comes as several rows, numbered by part: no task ever holds more of one.
    """
    rows = windows.numbered(assigned.filter(F.col("cluster_id").isNotNull()), ["cluster_id"], ["line_idx"], "at")
    if informative is not None:
        told = informative.select("line_idx", F.to_json(F.struct(*[c for c in informative.columns if c != "line_idx"])).alias("line"))
        rows = rows.join(told, "line_idx", "left")
    has_lines = informative is not None
    parts = rows.groupBy("cluster_id", F.floor(F.col("at") / most).alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_idx", *(["line"] if has_lines else [])))).alias("r"))
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_lines"), F.min_by("label", "line_idx").alias("label"))
    out = parts.join(sizes, "cluster_id")
    return out.select("cluster_id", "part", "num_lines", "label", F.col("r.line_idx").alias("indices"), *([F.col("r.line").alias("lines")] if has_lines else []))


def write_clusters(table: DataFrame, path: str) -> None:
    """One compact JSON object for each row of cluster_table()."""
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("overwrite").text(path)


def nearest(rows: DataFrame, others: DataFrame, key: str, limit_us: int = NEAR_US) -> DataFrame:
    """line_idx and the nearest other row of the same key within limit_us: at or after first, then priority, then line.

    Both sides are cut into slots of the limit's length and a row meets the three slots around its own, so the
    join is an equi-join however long the log is.
    """
    left = rows.select(F.col(key).alias("key"), "line_idx", "ts_us").withColumn("slot", F.explode(F.array(*[F.floor(F.col("ts_us") / limit_us) + d for d in (-1, 0, 1)])))
    right = others.select(F.col(key).alias("key"), F.col("line_idx").alias("other_idx"), F.col("ts_us").alias("other_us"), "priority").withColumn("slot", F.floor(F.col("other_us") / limit_us))
    delta = F.col("other_us") - F.col("ts_us")
    near = left.join(right, ["key", "slot"]).filter(F.abs(delta) <= limit_us)
    best = F.min(F.struct(F.abs(delta).alias("d"), (delta < 0).alias("before"), F.col("priority"), F.col("other_idx")))
    return near.groupBy("line_idx").agg(best.alias("b")).select("line_idx", F.col("b.other_idx").alias("other_idx"), F.col("b.d").alias("delta_us"))


def heartbeats(records: DataFrame, assigned: DataFrame, limit_us: int = NEAR_US) -> DataFrame:
    """assigned, with kubelet reads of the own node moved to the nearest lease renewal or node update of that node."""
    node = F.expr("CASE WHEN username LIKE 'system:node:%' THEN substr(username, 13) END")
    own = records.withColumn("node", node).filter("node = name AND node IS NOT NULL")
    reads = own.filter("verb = 'get' AND resource = 'nodes'")
    renewals = own.filter("verb IN ('update', 'patch') AND (resource = 'nodes' OR (resource = 'leases' AND namespace = 'kube-node-lease'))").withColumn("priority", F.expr("CASE WHEN resource = 'leases' THEN 0 ELSE 1 END"))
    moved = nearest(reads, renewals.filter(is_trigger()), "node", limit_us).join(assigned.select(F.col("line_idx").alias("other_idx"), F.col("cluster_id").alias("to")), "other_idx").select("line_idx", "to")
    to = F.when(F.col("cluster_id").isNotNull() & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("cluster_id"))
    return assigned.join(moved, "line_idx", "left").withColumn("cluster_id", to).drop("to")


def cluster_log(records: DataFrame, merge: bool = False) -> DataFrame:
    """Labelled records, as read from a log, to clusters: line_idx, label, cluster_id; heartbeats repaired. Proposals that they bring are kept."""
    proposed = records if "proposal" in records.columns else labels.propose(records)
    return heartbeats(proposed, stored(records.sparkSession, clustered(proposed, merge), "assigned"))  # asked for the renewals' clusters and for all
