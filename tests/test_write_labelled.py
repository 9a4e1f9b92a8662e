"""Labelled records: what stands in them, and what a large log costs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewright.sources import audit

SF = "/root/testdata/sf0.001"
LINES = [
    '{"requestReceivedTimestamp":"b","x":1.50,"i":12345678901234567890123}',
    ' {"requestReceivedTimestamp" : "a", "n":0.12345678901234567890123, "l":[1, {"m" : null}]}\t',
    '{"requestReceivedTimestamp":"c"} {"b":2}',
    "{}",
    '{"requestReceivedTimestamp":"d","s":"é\\u0001\\/ \\u003c }"}}',
    "{broken",
    "",
    '{"requestReceivedTimestamp":"d","a":1,"a":2}',
    '{"requestReceivedTimestamp":"d","n":0.12345678901234567890123}',
]


def told(text: str) -> dict:
    return json.JSONDecoder(parse_float=Decimal).raw_decode(text.strip())[0]


@pytest.mark.parametrize("line", [None, "value"])
def test_odd_lines(spark, tmp_path, line):
    records = audit.envelope(audit.parsed(spark.createDataFrame(list(enumerate(LINES)), "line_idx long, value string").repartition(3)))
    predictions = spark.createDataFrame([(0, 5), (2, 17808), (4, None), (5, 1), (99, 7)], "line_idx long, predicted int")
    audit.write_labelled(records, predictions, f"{tmp_path}/out", **({"line": line} if line else {}))
    back = spark.read.text(f"{tmp_path}/out").select("value").collect()
    assert [told(r.value) for r in back] == [told(LINES[k]) | {"predicted_label": p} for k, p in ((3, None), (1, None), (0, 5), (2, 17808), (4, None), (8, None))]
    assert all(json.loads(r.value) for r in back)  # nothing behind the object


@pytest.mark.parametrize("line", [None, "value"])
def test_records_are_made_once(spark, tmp_path, line):
    """Also with predictions that could be broadcast, ranges are sampled from what was shuffled."""
    asked = spark.sparkContext.accumulator(0)
    lines = spark.createDataFrame(spark.sparkContext.parallelize([(k, f'{{"requestReceivedTimestamp":"{k}"}}') for k in range(50)], 2).map(lambda r: asked.add(1) or r), "line_idx long, value string")
    audit.write_labelled(audit.envelope(audit.parsed(lines)), spark.range(9).selectExpr("id AS line_idx", "1 AS predicted"), f"{tmp_path}/out", **({"line": line} if line else {}))
    assert spark.read.text(f"{tmp_path}/out").count() == 50 and asked.value == 50


@pytest.mark.parametrize("strict", [False, True])
def test_lines_are_parsed_once(spark, strict):
    lines = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id AS line_idx", "props AS value", "1 AS raw")
    records = audit.parsed(lines, strict)
    plan = records.select("line_idx", F.to_json("raw").alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and records.columns == ["line_idx", "value", "raw"]


def test_lines_are_dealt_evenly(spark, tmp_path):
    """A file of one row group has all its rows in one of its splits."""
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        events = spark.read.parquet(f"{tmp_path}/events.parquet")
        assert events.rdd.getNumPartitions() > 4 and events.groupBy(F.spark_partition_id()).count().count() == 1
        dealt = [r["count"] for r in audit.audit_view(spark, str(tmp_path), True).select("line").groupBy(F.spark_partition_id()).count().collect()]
        assert len(dealt) >= 4 and len(dealt) % 4 == 0 and max(dealt) <= 2 * min(dealt) and sum(dealt) == events.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
