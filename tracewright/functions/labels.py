"""The 22-bit label: type, sub id, namespaced, single object, verb class. All expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import CRD_TYPES, IGNORE, IGNORED_NAMESPACES, UNKNOWN, VERB_IDS, catalog, catalog_rows

#: Verbs that may stand for each other when an operation is checked.
ALIKE = [("get", "list"), ("update", "patch"), ("delete", "deletecollection")]
#: The first verb of each id, as decoded labels show it.
SHOWN = {i: next(v for v, j in VERB_IDS.items() if j == i) for i in sorted(set(VERB_IDS.values()))}


def truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def verb_id(verb: Column, strict: bool = False) -> Column:
    """The verb's class; null for a verb that there isn't, or with strict an error."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in VERB_IDS.items() for x in kv]), verb)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("not a verb: "), F.coalesce(verb, F.lit("null")))).cast("int")) if strict else found


def encode(type_id: Column, sub_id: Column, namespaced: Column, single: Column, verb: Column) -> Column:
    """Sub ids from 8 on keep their upper bits in the low nibble."""
    return (type_id * 4096 + (sub_id % 8) * 512 + namespaced.cast("int") * 256 + single.cast("int") * 128 + verb * 16 + F.floor(sub_id / 8)).cast("int")


def part(label: Column, divisor: int, modulus: int) -> Column:
    return (F.floor(label / divisor) % modulus).cast("int")


def decode(label: Column) -> dict[str, Column]:
    """type_id, sub_id, namespaced, single, verb_id of a label; null for sentinels."""
    ok = label >= 0
    out = {"type_id": F.floor(label / 4096).cast("int"), "sub_id": part(label, 512, 8) + 8 * (label % 16).cast("int"), "is_namespaced": part(label, 256, 2) == 1, "is_single": part(label, 128, 2) == 1, "verb_id": part(label, 16, 8)}
    return {k: F.when(ok, v) for k, v in out.items()}


def is_crd(label: Column) -> Column:
    return F.coalesce(F.floor(label / 4096).isin(*CRD_TYPES), F.lit(False))


def allowed(verb: Column, verbs: Column) -> Column:
    """The verb, or one that it may stand for, is among those of the resource."""
    out = F.array_contains(verbs, verb)
    for pair in ALIKE:
        out = F.when(verb.isin(*pair), F.arrays_overlap(verbs, F.array(*map(F.lit, pair)))).otherwise(out)
    return out


def with_entry(records: DataFrame) -> DataFrame:
    """Each record with its catalog entry: unseen groups take the external resource, unlisted ones of known groups none."""
    spark = records.sparkSession
    group = F.coalesce("api_group", F.lit("core"))
    seen = group.isin(*sorted({r[0] for r in catalog_rows()}))
    name = F.concat_ws("/", F.col("resource"), F.when(truthy(F.col("subresource")), F.col("subresource")))
    keyed = records.withColumns({"_g": F.when(seen, group).otherwise("unknown.fbk.eu"), "_v": F.when(seen, F.col("api_version")).otherwise("noversion"), "_n": F.when(seen, name).otherwise("externalcrd")})
    entry = F.broadcast(catalog(spark))  # as many rows as the catalog
    return keyed.join(entry, (F.col("_g") == F.col("cat_group")) & (F.col("_v") == F.col("cat_version")) & (F.col("_n") == F.col("cat_name")), "left").drop("_g", "_v", "_n")


def proposal(verb: Column) -> Column:
    """The label of a record of with_entry(), as if it had this verb."""
    parts = F.split(F.substring_index("uri", "?", 1), "/")
    made = encode(F.col("type_id"), F.col("sub_id"), truthy(F.col("namespace")), truthy(F.col("name")), verb_id(verb))
    label = (
        F.when(~F.col("has_ref"), UNKNOWN)
        .when(~F.coalesce(F.get(parts, 1).isin("api", "apis"), F.lit(False)), IGNORE)
        .when(F.size(parts) <= 3, IGNORE)
        .when(F.coalesce(F.col("namespace").isin(*IGNORED_NAMESPACES), F.lit(False)), IGNORE)
        .when(allowed(verb, F.col("verbs")), made)
    )
    return F.coalesce(label, F.lit(UNKNOWN)).cast("int")


def propose(records: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    """Adds `proposal`, and for further column names the labels that the record would have with those verbs. Wants has_ref, uri, verb, api_group, api_version, resource, subresource, namespace, name."""
    columns = {"proposal": proposal(F.col("verb")), **{name: proposal(F.lit(verb)) for name, verb in (others or {}).items()}}
    return with_entry(records).withColumns(columns).drop("cat_group", "cat_version", "cat_name", "type_id", "sub_id", "namespaced", "verbs")


def label_space(spark) -> DataFrame:
    """Every label that the catalog allows, and the unknown one."""
    entries = catalog(spark).withColumn("verb", F.explode("verbs")).withColumn("verb_id", verb_id(F.col("verb")))
    flags = F.explode(F.array(F.lit(False), F.lit(True)))
    full = entries.withColumn("ns", flags).withColumn("single", flags)
    made = full.select(encode(F.col("type_id"), F.col("sub_id"), F.col("ns"), F.col("single"), F.col("verb_id")).alias("label")).distinct()
    return made.unionByName(spark.sql(f"SELECT {UNKNOWN} AS label"))


def decoded(labels: DataFrame) -> DataFrame:
    """label with its parts, catalog entry and text form; `error` where it can't be decoded."""
    spark = labels.sparkSession
    parts = decode(F.col("label"))
    entry = catalog(spark).select("cat_group", "cat_version", "cat_name", F.col("type_id").alias("t"), F.col("sub_id").alias("s"))
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), F.col("verb_id"))
    out = labels.withColumns(parts).join(F.broadcast(entry), (F.col("type_id") == F.col("t")) & (F.col("sub_id") == F.col("s")), "left").drop("t", "s").withColumn("verb", shown)
    bad = F.col("cat_name").isNull() | F.col("verb").isNull()
    text = F.concat_ws(" ", "verb", F.concat_ws("/", "cat_group", "cat_version", "cat_name"), F.when(F.col("is_namespaced"), "(ns)"), F.when(F.col("is_single"), "(single)").otherwise("(list)"))
    return out.withColumn("error", bad).withColumn("label_text", F.when(~bad, text))
