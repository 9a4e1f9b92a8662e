"""Clusters kept for reading: a table in buckets by cluster, each in order of time, of which a look at one cluster reads one bucket."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows of a bucket, about.
BUCKET_ROWS = 1 << 20


def write_store(rows: DataFrame, name: str | None = None, cluster: str = "cluster_id", ts: str = "ts_us", buckets: int | None = None) -> str:
    """The rows as a table in buckets by cluster, sorted by cluster and time; its name. A bucket has about BUCKET_ROWS rows, a cluster lies in one bucket."""
    spark = rows.sparkSession
    name = name or f"clusters_{uuid.uuid4().hex}"
    many = buckets or max(8, math.ceil(rows.count() / BUCKET_ROWS))
    dealt = rows.repartition(many, cluster)  # as buckets are dealt, so that each is one file
    dealt.write.bucketBy(many, cluster).sortBy(cluster, ts).option("path", f"{shared_dir(spark)}/{name}").mode("overwrite").saveAsTable(name)
    return name


def detail(spark: SparkSession, name: str, which, start_us: int | None = None, end_us: int | None = None, cluster: str = "cluster_id", ts: str = "ts_us") -> DataFrame:
    """The records of one cluster, of a span of time if given, in order."""
    rows = spark.table(name).filter(F.col(cluster) == which)
    if start_us is not None:
        rows = rows.filter(F.col(ts) >= start_us)
    if end_us is not None:
        rows = rows.filter(F.col(ts) < end_us)
    return rows.orderBy(ts)


def legend(spark: SparkSession, name: str, cluster: str = "cluster_id", ts: str = "ts_us") -> DataFrame:
    """Of each cluster its size and span; buckets are counted where they lie, nothing is shuffled."""
    return spark.table(name).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.min(ts).alias("first_us"), F.max(ts).alias("last_us"))
