"""Resource catalog and verb ids: small dimension tables, read from the CSV files beside this module or from others in their form."""

from __future__ import annotations

import configparser
import csv
import pkgutil
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Entries in catalog.csv (group, version, resource[/subresource], type id, sub id, namespaced, a column a verb) and verb ids in verbs.csv.

# Sentinels.
UNKNOWN, IGNORE, BOUNDARY = -1, -2, -3
CRD_TYPES = (666, 667)
IGNORED_NAMESPACES = ("falco", "kube-flannel")


def csv_rows(text: str) -> list[list[str]]:
    return [r for r in csv.reader(text.splitlines()) if r and not r[0].startswith("#")]


def parse_catalog(text: str) -> list[tuple]:
    """(api_group, api_version, name, type_id, sub_id, namespaced, verbs); blank verbs are left out, a repeated key or (type, sub) is an error."""
    rows, keys, ids = [], set(), set()
    for group, version, name, kind, sub, namespaced, *verbs in csv_rows(text):
        if (group, version, name) in keys or (kind, sub) in ids:
            raise ValueError(f"catalog entry twice: {group}/{version}/{name} {kind}.{sub}")
        keys.add((group, version, name))
        ids.add((kind, sub))
        rows.append((group, version, name, int(kind), int(sub), namespaced == "true", [v for v in verbs if v]))
    return rows


def parse_verbs(text: str) -> dict[str, int]:
    return {verb: int(i) for verb, i in csv_rows(text)}


def parse_toggles(text: str) -> tuple[str, ...]:
    """The rules that an ini file (section ignore_log) turns off; what it doesn't name stays on."""
    ini = configparser.ConfigParser()
    ini.read_string(text)
    return tuple(k for k in ini["ignore_log"] if not ini["ignore_log"].getboolean(k))


def beside(name: str) -> str:
    return pkgutil.get_data(__package__, name).decode()  # from a zip file too


@cache
def catalog_rows() -> tuple[tuple, ...]:
    return tuple(parse_catalog(beside("catalog.csv")))


VERB_IDS = parse_verbs(beside("verbs.csv"))


def quoted(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def catalog(spark: SparkSession, rows=None) -> DataFrame:
    """The entries (98 in the one that comes with this) as an inline relation, which a join broadcasts without a job."""
    values = ", ".join(f"({quoted(g)}, {quoted(v)}, {quoted(n)}, {t}, {s}, {str(ns).lower()}, array({', '.join(map(quoted, vs))}))" for g, v, n, t, s, ns, vs in rows or catalog_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS c(cat_group, cat_version, cat_name, type_id, sub_id, namespaced, verbs)")


def verbs(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(v)}, {i})" for v, i in VERB_IDS.items()) + " AS v(verb, verb_id)")


def catalog_sql() -> str:
    """The catalog as VALUES for a SQL oracle."""
    values = ", ".join(f"('{g}', '{v}', '{n}', {t}, {s}, {str(ns).lower()}, {vs!r})" for g, v, n, t, s, ns, vs in catalog_rows())
    return f"catalog(cat_group, cat_version, cat_name, type_id, sub_id, namespaced, verbs) AS (SELECT * FROM (VALUES {values}))"
