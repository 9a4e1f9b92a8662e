"""Gap sessions as a stream: a burst of one kind of event is given out once the watermark has passed its gap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def gap_sessions(stream: DataFrame, key: str, gap: str = "300 seconds", late: str = "300 seconds") -> DataFrame:
    """key, start, stop and size of each run of events with no gap beyond the limit; state is one row per open run."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of a stored table, streamed to the end and written as a table of its own."""
    schema = spark.read.parquet(path).schema
    top, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(top).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    q = gap_sessions(source, "event_type").writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema("event_type string, start timestamp, stop timestamp, n long").parquet(out)
