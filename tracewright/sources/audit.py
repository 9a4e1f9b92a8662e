"""Audit records: JSON Lines in and out, typed envelope beside the untouched payload, and a view of `events`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Columns of a record and the path of each in the payload.
ENVELOPE = {
    "uri": "$.requestURI",
    "verb": "$.verb",
    "stage": "$.stage",
    "received_raw": "$.requestReceivedTimestamp",
    "stage_raw": "$.stageTimestamp",
    "username": "$.user.username",
    "user_agent": "$.userAgent",
    "api_group": "$.objectRef.apiGroup",
    "api_version": "$.objectRef.apiVersion",
    "resource": "$.objectRef.resource",
    "subresource": "$.objectRef.subresource",
    "namespace": "$.objectRef.namespace",
    "name": "$.objectRef.name",
}


def parsed(lines: DataFrame, strict: bool = False) -> DataFrame:
    """value -> raw (variant). strict: a malformed line fails the query; else it is left out, as blank ones are.

    The variant comes out of an array of one, as a filter on a plain column would parse each line once more.
    """
    raw = F.parse_json("value") if strict else F.try_parse_json("value")
    return lines.filter(F.trim("value") != "").drop("raw").select("*", F.explode(F.array(raw)).alias("raw")).filter(F.col("raw").isNotNull())


def read_audit_jsonl(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """line_idx, raw and the envelope. line_idx grows along each file but has gaps; order by it, don't count by it."""
    lines = spark.read.text(paths).withColumn("line_idx", F.monotonically_increasing_id())
    return envelope(parsed(lines, strict)).drop("value")


def has_path(raw: str, *keys: str) -> F.Column:
    """True if the keys lead somewhere, JSON null included: that is a value there, other than what is missing."""
    return F.try_variant_get(raw, "$" + "".join(f"['{x}']" for x in keys), "variant").isNotNull()


def envelope(records: DataFrame) -> DataFrame:
    columns = {c: F.try_variant_get("raw", p, "string") for c, p in ENVELOPE.items()}
    columns["groups"] = F.try_variant_get("raw", "$.user.groups", "array<string>")
    columns["code"] = F.try_variant_get("raw", "$.responseStatus.code", "int")
    columns["decision"] = F.try_variant_get("raw", "$.annotations['authorization.k8s.io/decision']", "string")
    columns["label"] = F.try_variant_get("raw", "$.label", "int")
    columns["has_ref"] = has_path("raw", "objectRef")
    columns["has_namespace_key"] = has_path("raw", "objectRef", "namespace")
    columns["legacy_token"] = has_path("raw", "requestObject", "metadata", "labels", "kubernetes.io/legacy-token-last-used")
    out = records.withColumns(columns)
    return out.withColumns({"ts_us": F.unix_micros(F.try_to_timestamp("received_raw")), "user_groups": F.concat(F.lit(","), F.array_join(F.coalesce("groups", F.array().cast("array<string>")), ","), F.lit(","))})


def tolerant(lines: DataFrame) -> DataFrame:
    """Records of lines (line_idx, value) with a readable timestamp; blank and malformed ones are left out."""
    return envelope(parsed(lines)).filter(F.col("ts_us").isNotNull())


def clusterized(lines: DataFrame) -> DataFrame:
    """As tolerant(), with cluster ids; records without one are left out."""
    return tolerant(lines).withColumn("cluster_id", F.try_variant_get("raw", "$.uuid_new", "string")).filter(F.col("cluster_id").isNotNull())


def read_tolerant(spark: SparkSession, paths) -> DataFrame:
    return tolerant(spark.read.text(paths).withColumn("line_idx", F.monotonically_increasing_id())).drop("value")


def optional(records: DataFrame) -> DataFrame:
    """Adds what only some records have: uid, owner_uids (owners may be a list or one object), involved and claim."""
    from ..functions.scalars import uid

    def part(path: str, *keys: str):
        some = F.schema_of_variant(F.try_variant_get("raw", path, "variant")).startswith("OBJECT<") & (F.to_json(F.try_variant_get("raw", path, "variant")) != "{}")
        return F.when(some, F.struct(*[F.try_variant_get("raw", f"{path}.{k}", "string").alias(k) for k in keys]))

    owners = "$.responseObject.metadata.ownerReferences"
    listed = F.transform(F.try_variant_get("raw", owners, "array<variant>"), lambda o: F.try_variant_get(o, "$.uid", "string"))
    alone = F.array(F.try_variant_get("raw", owners + ".uid", "string"))
    return records.withColumns(
        {
            "uid": uid(),
            "owner_uids": F.array_compact(F.coalesce(listed, alone)),
            "involved": part("$.responseObject.involvedObject", "kind", "namespace", "name", "resource"),
            "claim": part("$.responseObject.spec.claimRef", "kind", "namespace", "name"),
        }
    )


def read_clusterized(spark: SparkSession, paths) -> DataFrame:
    return clusterized(spark.read.text(paths).withColumn("line_idx", F.monotonically_increasing_id())).drop("value")


def write_jsonl(records: DataFrame, path: str, order: str = "received_raw") -> None:
    """One compact JSON object a line; a range-partitioned sort orders the files."""
    records.orderBy(order, "line_idx").select(F.to_json("raw").alias("value")).write.mode("overwrite").text(path)


def write_labelled(records: DataFrame, predictions: DataFrame, path: str, order: str = "received_raw", line: str | None = None) -> None:
    """The records with predicted_label (null without a prediction) beside what they hold, as JSON lines in order. predictions: line_idx, predicted.

    line: the column of the lines that the records were read from, if they still have it; copying those costs far less than writing raw.
    The texts are shuffled for the join even where predictions could be broadcast: else all of them would be made once more when ranges are sampled.
    """
    keys = dict.fromkeys(["line_idx", order])
    texts = (copied(records.select(*keys, "raw", F.col(line).alias("_line"))) if line else records.withColumn("_text", F.to_json("raw"))).select(*keys, "_text")
    rows = texts.hint("merge").join(predictions.select("line_idx", "predicted"), "line_idx", "left").orderBy(order, "line_idx")
    comma = F.when(F.col("_text") == "{}", "").otherwise(",")
    shown = F.concat(F.substring("_text", F.lit(1), F.length("_text") - 1), comma, F.lit('"predicted_label":'), F.coalesce(F.col("predicted").cast("string"), F.lit("null")), F.lit("}"))
    rows.select(shown.alias("value")).write.mode("overwrite").text(path)


def copied(records: DataFrame) -> DataFrame:
    """Adds _text, the record's JSON in compact form: what _line begins with, or raw where the copy may have rounded a number (a double keeps 15 digits)."""
    same = (F.col("_copy") == F.col("_line")) | ~F.col("_line").rlike("[0-9.]{17}")
    return records.withColumn("_copy", F.get_json_object("_line", "$")).withColumn("_text", F.coalesce(F.when(same, F.col("_copy")), F.to_json("raw")))


def cut_log(lines: DataFrame) -> DataFrame:
    """What is left of a log that was cut anywhere: the lines that are whole JSON objects, however compressed the files were."""
    return lines.filter(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))


#: The view of the events table: steps of (column, expression); {K} and {US} differ between engines.
VIEW = [
    [("line_idx", "event_id"), ("ts_us", "{US}"), ("k", "{K}"), ("user_id", "user_id"), ("event_type", "event_type"), ("value", "value")],
    [
        ("verb", "CASE line_idx % 8 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN 'deletecollection' WHEN 3 THEN 'get' WHEN 4 THEN 'list' WHEN 5 THEN 'patch' WHEN 6 THEN 'update' ELSE 'watch' END"),
        ("resource", "CASE k % 14 WHEN 0 THEN 'pods' WHEN 1 THEN 'nodes' WHEN 2 THEN 'leases' WHEN 3 THEN 'configmaps' WHEN 4 THEN 'secrets' WHEN 5 THEN 'serviceaccounts' WHEN 6 THEN 'services' WHEN 7 THEN 'endpoints' WHEN 8 THEN 'namespaces' WHEN 9 THEN 'deployments' WHEN 10 THEN 'widgets' WHEN 11 THEN 'flowschemas' WHEN 12 THEN 'limitranges' ELSE 'clusterroles' END"),
        ("username", "CASE user_id % 8 WHEN 0 THEN 'system:apiserver' WHEN 1 THEN 'system:kube-controller-manager' WHEN 2 THEN 'system:kube-scheduler' WHEN 3 THEN concat('system:node:worker-', CAST(k % 3 AS VARCHAR(9))) WHEN 4 THEN 'system:serviceaccount:kube-system:coredns' WHEN 5 THEN 'system:serviceaccount:kube-system:kube-proxy' WHEN 6 THEN concat('user-', CAST(user_id AS VARCHAR(9))) ELSE 'system:serviceaccount:kube-system:node-controller' END"),
        ("user_groups", "CASE user_id % 8 WHEN 3 THEN ',system:nodes,system:authenticated,' WHEN 4 THEN ',system:serviceaccounts,' WHEN 5 THEN ',system:serviceaccounts,' WHEN 7 THEN ',system:serviceaccounts,' ELSE ',system:authenticated,' END"),
        ("has_ref", "line_idx % 97 <> 0"),
        ("has_namespace_key", "line_idx % 10 <> 9"),
        ("stage", "CASE WHEN line_idx % 13 = 0 THEN 'ResponseStarted' ELSE 'ResponseComplete' END"),
        ("code", "CASE WHEN line_idx % 17 = 0 THEN 403 WHEN line_idx % 8 = 0 THEN 201 ELSE 200 END"),
        ("legacy_token", "line_idx % 3 = 0"),
        ("decision", "CASE WHEN line_idx % 29 = 0 THEN 'forbid' ELSE 'allow' END"),
    ],
    [
        ("api_group", "CASE resource WHEN 'leases' THEN 'coordination.k8s.io' WHEN 'deployments' THEN 'apps' WHEN 'widgets' THEN 'example.com' WHEN 'flowschemas' THEN 'flowcontrol.apiserver.k8s.io' WHEN 'clusterroles' THEN 'rbac.authorization.k8s.io' ELSE NULL END"),
        ("api_version", "'v1'"),
        ("subresource", "CASE WHEN resource = 'serviceaccounts' AND verb = 'create' THEN 'token' WHEN resource = 'pods' AND line_idx % 5 = 0 THEN 'exec' WHEN resource = 'deployments' AND line_idx % 5 = 1 THEN 'scale' WHEN resource = 'nodes' AND line_idx % 7 = 0 THEN 'proxy' ELSE NULL END"),
        ("namespace", "CASE WHEN resource IN ('nodes', 'namespaces', 'clusterroles', 'flowschemas') THEN NULL WHEN NOT has_namespace_key THEN NULL WHEN line_idx % 11 = 0 THEN 'falco' WHEN resource = 'leases' AND username LIKE 'system:node:%' THEN 'kube-node-lease' WHEN user_id % 5 IN (0, 1) THEN 'kube-system' WHEN user_id % 5 = 2 THEN 'default' WHEN user_id % 5 = 3 THEN concat('team-', CAST(k % 4 AS VARCHAR(9))) ELSE NULL END"),
        ("name", "CASE WHEN verb IN ('list', 'deletecollection') OR line_idx % 3 = 0 THEN NULL WHEN resource = 'leases' THEN CASE k % 4 WHEN 0 THEN 'kube-controller-manager' WHEN 1 THEN 'kube-scheduler' WHEN 2 THEN 'apiserver-x1' ELSE concat('worker-', CAST(k % 3 AS VARCHAR(9))) END WHEN resource = 'nodes' THEN concat('worker-', CAST(k % 3 AS VARCHAR(9))) WHEN resource = 'serviceaccounts' THEN CASE k % 3 WHEN 0 THEN 'generic-garbage-collector' WHEN 1 THEN 'resourcequota-controller' ELSE 'builder' END WHEN resource = 'configmaps' THEN CASE k % 2 WHEN 0 THEN 'extension-apiserver-authentication' ELSE 'kube-root-ca.crt' END WHEN resource = 'endpoints' THEN 'kubernetes' ELSE concat('obj-', CAST(k AS VARCHAR(9))) END"),
    ],
    [("uri", "CASE WHEN line_idx % 101 = 0 THEN '/readyz' WHEN line_idx % 103 = 0 THEN '/api/v1' WHEN line_idx % 107 = 0 THEN '/healthz' WHEN api_group IS NULL THEN concat('/api/v1/', resource, CASE WHEN verb = 'watch' THEN '?watch=1' ELSE '' END) ELSE concat('/apis/', api_group, '/v1/', resource) END")],
]
RAW = """concat('{{"verb":"', verb, '","stage":"', stage, '","requestURI":"', uri, '","requestReceivedTimestamp":"', {TS}, '","userAgent":"tool-', CAST(user_id AS VARCHAR(9)), '/v1 (linux/amd64) kubernetes/abc","user":{{"username":"', username, '","groups":["system:authenticated","g', CAST(user_id % 3 AS VARCHAR(9)), '"]}}', CASE WHEN has_ref THEN concat(',"objectRef":{{"resource":"', resource, '"', CASE WHEN subresource IS NOT NULL THEN concat(',"subresource":"', subresource, '"') ELSE '' END, CASE WHEN NOT has_namespace_key THEN '' WHEN namespace IS NULL THEN ',"namespace":null' ELSE concat(',"namespace":"', namespace, '"') END, CASE WHEN name IS NOT NULL THEN concat(',"name":"', name, '"') ELSE '' END, CASE WHEN api_group IS NOT NULL THEN concat(',"apiGroup":"', api_group, '"') ELSE '' END, ',"apiVersion":"v1"}}') ELSE '' END, ',"annotations":{{"authorization.k8s.io/decision":"', decision, '"}},"responseStatus":{{"code":', CAST(code AS VARCHAR(9)), CASE WHEN line_idx % 4 = 3 THEN concat(',"details":{{"uid":"uid-', CAST(k AS VARCHAR(9)), '"}}') ELSE '' END, '}},"responseObject":{{"kind":"K', CAST(k % 5 AS VARCHAR(9)), '","metadata":{{"name":"m"', CASE WHEN line_idx % 4 = 0 THEN concat(',"uid":"uid-', CAST(k AS VARCHAR(9)), '"') WHEN line_idx % 4 = 1 THEN ',"uid":null' ELSE '' END, CASE WHEN line_idx % 6 = 1 THEN concat(',"ownerReferences":[{{"uid":"uid-', CAST((k + 1) % 100 AS VARCHAR(9)), '"}},{{"kind":"x"}}]') WHEN line_idx % 6 = 4 THEN concat(',"ownerReferences":{{"uid":"uid-', CAST((k + 2) % 100 AS VARCHAR(9)), '"}}') ELSE '' END, '}}', CASE WHEN line_idx % 4 <> 3 THEN concat(',"details":{{"uid":"det-', CAST(k AS VARCHAR(9)), '"}}') ELSE '' END, CASE WHEN line_idx % 9 = 2 THEN concat(',"involvedObject":{{"kind":"Pod","namespace":"default","name":"obj-', CAST(k AS VARCHAR(9)), '","resource":"pods","uid":"z"}}') ELSE '' END, CASE WHEN line_idx % 15 = 4 THEN concat(',"spec":{{"claimRef":{{"kind":"PersistentVolumeClaim","namespace":"team-', CAST(k % 4 AS VARCHAR(9)), '","name":"obj-', CAST(k AS VARCHAR(9)), '"}}}}') ELSE '' END, '}}}}')"""
VIEW.append([("line", RAW)])
SPARK = {"K": "CAST(get_json_object(props, '$.k') AS INT)", "US": "unix_micros(CAST(ts AS TIMESTAMP))", "TS": "concat(date_format(timestamp_micros(ts_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z')"}
DUCK = {"K": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "US": "epoch_us(ts)", "TS": "concat(strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f'), 'Z')"}


def audit_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The events table as lines of a log: line_idx, value (JSON) and more columns of the view; stored, as a log is."""
    return stored(spark, audit_view(spark, sf_dir, True).select("line_idx", F.col("line").alias("value"), *more), "lines")


def audit_view(spark: SparkSession, sf_dir: str, lines: bool = False, apart: bool = False) -> DataFrame:
    """The events table in the shape of audit records; lines: with the JSON of each.

    With lines, and for what comes after the view with apart, code is compiled in pieces: a coalesce() that changes nothing parts
    them, as in one piece it would be too long for the JVM. Rows are then dealt evenly to the cores first: few row groups may hold all
    rows of a file, however many splits it has.
    """
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    if lines or apart:
        cores = spark.sparkContext.defaultParallelism
        many = cores * max(1, math.ceil(df.rdd.getNumPartitions() / cores))
        df = df.repartition(many)
    for k, step in enumerate(VIEW if lines else VIEW[:-1]):
        columns = [f"{e.format(**SPARK).replace('VARCHAR(9)', 'STRING')} AS {c}" for c, e in step]
        if step is VIEW[-1]:
            df = df.coalesce(many)
        df = df.selectExpr(*columns) if k == 0 else df.selectExpr("*", *columns)
    return df.coalesce(many) if apart else df


def audit_sql() -> str:
    """The same as CTEs for a SQL oracle; the last is called audit."""
    out, source = [], "events"
    for k, step in enumerate(VIEW):
        name = "audit" if k == len(VIEW) - 1 else f"audit{k}"
        columns = ", ".join(f"{e.format(**DUCK)} AS {c}" for c, e in step)
        out.append(f"{name} AS (SELECT {'*, ' if k else ''}{columns} FROM {source})")
        source = name
    return ", ".join(out)
