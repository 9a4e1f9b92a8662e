"""Row-level functions over audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

AGENT = ("tool", "version", "platform", "arch", "h", "extra")

# The model's features, by path.
FEATURES = """
objectRef.apiGroup objectRef.namespace objectRef.resource objectRef.subresource
user.groups[0] user.groups[1] user.groups[2] userAgent.extra userAgent.tool userAgent.version verb
requestObject.kind requestObject.apiVersion requestObject.metadata.namespace
requestObject.metadata.ownerReferences.apiVersion requestObject.metadata.ownerReferences.kind
requestObject.metadata.ownerReferences.controller requestObject.metadata.ownerReferences.blockOwnerDeletion
requestObject.volumeBindingMode requestObject.spec.volumeMode responseObject.spec.volumeMode
responseObject.kind responseObject.metadata.namespace
responseObject.metadata.ownerReferences.apiVersion responseObject.metadata.ownerReferences.kind
responseObject.metadata.ownerReferences.controller responseObject.metadata.ownerReferences.blockOwnerDeletion
responseObject.involvedObject.apiVersion responseObject.involvedObject.kind responseObject.involvedObject.namespace
responseObject.involvedObject.resource responseObject.involvedObject.subresource
responseObject.reason responseObject.count responseObject.type responseObject.reportingComponent
responseObject.source.component annotations.authorization.k8s.io/decision responseStatus.code
""".split()
NAMESPACES = ("objectRef.namespace", "responseObject.metadata.namespace", "responseObject.involvedObject.namespace")


def user_agent(agent: Column) -> dict[str, Column]:
    """tool, version, platform, arch, h, extra; all null where the string has another shape."""
    words = F.split(agent, " ")
    n = F.size(words)
    tool, place = F.get(words, 0), F.regexp_replace(F.get(words, 1), "[()]", "")
    meta = F.when(n == 3, F.split(F.get(words, 2), "/"))
    has_place = (n >= 2) & (F.get(words, 1) != "")
    has_meta = (n == 3) & (F.get(words, 2) != "")
    ok = tool.contains("/") & (~has_place | place.contains("/")) & (~has_meta | F.size(meta).isin(2, 3))
    after = {"tool": F.substring_index(tool, "/", 1), "version": F.regexp_replace(tool, "^[^/]*/", ""), "platform": F.when(has_place, F.substring_index(place, "/", 1)), "arch": F.when(has_place, F.regexp_replace(place, "^[^/]*/", "")), "h": F.when(has_meta, F.get(meta, 1)), "extra": F.when(has_meta, F.get(meta, 2))}
    return {k: F.when(F.coalesce(ok, F.lit(False)), v) for k, v in after.items()}


def short_username(user: Column) -> Column:
    return F.when(user.startswith("system:serviceaccount:"), F.concat(F.lit("sys:sa:"), F.regexp_replace(user, "^[^:]*:[^:]*:", ""))).when(user.startswith("system:"), F.concat(F.lit("sys:"), F.regexp_replace(user, "^[^:]*:", ""))).otherwise(user)


def action_summary() -> Column:
    def tail(c):
        return F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.concat(F.lit("/"), F.col(c))).otherwise("")

    return F.concat(F.coalesce("verb", F.lit("?")), F.lit(" "), F.coalesce(F.when(F.col("resource") != "", F.col("resource")), F.lit("?")), tail("namespace"), tail("name"))


def node_identity() -> Column:
    """The node's name where a kubelet reads itself."""
    node = F.expr("substr(username, 13)")
    return F.when(F.col("username").startswith("system:node:") & (F.col("name") == node), node)


def format_ts(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSS")


def color_hue(key: Column) -> Column:
    """A hue that is the same in every run."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 360).cast("int")


def binarised(c: Column, present: Column) -> Column:
    return F.when(present, F.coalesce(c != "", F.lit(False)).cast("int"))


def uid(raw: str = "raw") -> Column:
    """metadata.uid; only where that key is absent details.uid, then the status's."""
    from ..sources.audit import has_path

    first, second = F.try_variant_get(raw, "$.responseObject.metadata.uid", "string"), F.try_variant_get(raw, "$.responseObject.details.uid", "string")
    third = F.try_variant_get(raw, "$.responseStatus.details.uid", "string")
    return F.when(has_path(raw, "responseObject", "metadata", "uid"), first).when(has_path(raw, "responseObject", "details", "uid"), second).otherwise(third)


def informative(records: DataFrame) -> DataFrame:
    """The flat projection of records that have an objectRef."""
    optional = {"ownerReferences": "$.responseObject.metadata.ownerReferences", "involvedObject": "$.responseObject.involvedObject", "claimRef": "$.responseObject.spec.claimRef"}
    extra = {k: F.to_json(F.try_variant_get("raw", p, "variant")) for k, p in optional.items()} if "raw" in records.columns else {}
    if extra:
        extra |= {"reason": F.try_variant_get("raw", "$.responseObject.reason", "string"), "uid": uid()}
    return records.filter("has_ref").select("line_idx", "username", "verb", "resource", "subresource", "namespace", "name", F.substring_index("uri", "?", 1).alias("requestURI"), *[F.col(c) for c in ("received_raw", "stage_raw") if c in records.columns], *[c.alias(k) for k, c in extra.items()])


def path_of(feature: str) -> str:
    if feature.startswith("annotations."):
        return "$.annotations['" + feature.removeprefix("annotations.") + "']"
    return "$." + feature


def features(records: DataFrame, drop: tuple[int, ...] = ()) -> DataFrame:
    """line_idx and one string column a feature, sorted by name; drop: indices into that order to leave out."""
    names = [f for k, f in enumerate(sorted(FEATURES)) if k not in drop]
    agent = user_agent(F.try_variant_get("raw", "$.userAgent", "string"))
    verbs = F.expr("CASE verb WHEN 'create' THEN 1 WHEN 'delete' THEN 2 WHEN 'deletecollection' THEN 2 WHEN 'get' THEN 3 WHEN 'list' THEN 3 WHEN 'patch' THEN 4 WHEN 'update' THEN 4 WHEN 'watch' THEN 5 END")

    def one(f):
        if f.startswith("userAgent."):
            return agent[f.split(".")[1]]
        if f == "verb":
            return verbs.cast("string")
        value = F.try_variant_get("raw", path_of(f), "string")
        if f in NAMESPACES:
            from ..sources.audit import has_path

            return binarised(value, has_path("raw", *f.split("."))).cast("string")
        return value

    return records.select("line_idx", *[one(f).alias(f) for f in names])


def stage_epoch(stage: Column) -> Column:
    """Whole seconds of a stage timestamp."""
    return F.unix_seconds(F.try_to_timestamp(stage))


#: Levels that flattened() goes down in one pass.
LEVELS = 8


def flattened(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(line_idx, path, value) of every scalar, as a.b and a[0].b, however deep; empty objects and lists vanish. A pass goes down some levels and is stored; what lies deeper takes another."""
    spark = records.sparkSession
    at, out, first = records.select("line_idx", F.lit("").alias("path"), F.col("raw").alias("v")), None, True
    while True:
        for k in range(levels):
            explode = spark.tvf.variant_explode_outer if first or k else spark.tvf.variant_explode  # a later pass begins with what has children, or vanishes
            table = explode(F.col("v").outer())
            name = F.when(F.col("pos").isNull(), F.col("path")).when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), F.col("key")))
            at = at.lateralJoin(table).select("line_idx", name.alias("path"), F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"))
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        known = stored(spark, at.select("line_idx", "path", F.when(inner, F.to_json("v")).alias("json"), F.when(~inner, F.try_variant_get("v", "$", "string")).alias("value")), "level")
        leaf = known.filter("json IS NULL").select("line_idx", "path", "value")
        out = leaf if out is None else out.unionByName(leaf)
        more = known.filter("json NOT IN ('{}', '[]')")
        if more.isEmpty():
            return out
        at, first = more.select("line_idx", "path", F.parse_json("json").alias("v")), False


def feature_stats(features: DataFrame, top: int = 0) -> DataFrame:
    """feature, n (distinct values), known (records that have it) of every column of features() that any record has, in one pass; with top also the most frequent values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in features.columns if c != "line_idx"])).alias("x")
    counts = features.select(each).select("x.*").filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))
    measures = [F.count(F.lit(1)).alias("n"), F.sum("rows").cast("long").alias("known")]
    if not top:
        return counts.groupBy("feature").agg(*measures)
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("rows"), "value"))
    often = counts.withColumn("place", place).filter(F.col("place") <= top).groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("often"))
    return counts.groupBy("feature").agg(*measures).join(often, "feature")
