"""The cluster store: what it gives, and what a look at it reads."""

import os

from pyspark.sql import functions as F

from tracewright.plans import store


def test_detail_reads_one_bucket(spark, capsys):
    df = spark.range(4000).select(F.concat(F.lit("c"), F.col("id") % 40).alias("cluster_id"), (4000 - F.col("id")).alias("ts_us"), F.col("id").alias("line_idx"))
    name = store.write_store(df, buckets=8)
    one = store.detail(spark, name, "c7", 100, 3000)
    assert [r.line_idx for r in one.collect()] == [k for k in range(3999, -1, -1) if k % 40 == 7 and 100 <= 4000 - k < 3000]
    one.explain("formatted")
    assert "GreaterThanOrEqual(ts_us,100)" in capsys.readouterr().out
    told = store.legend(spark, name)
    told.explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
    assert {r.cluster_id: (r["size"], r.first_us, r.last_us) for r in told.collect()} == {f"c{c}": (100, 4000 - c - 99 * 40, 4000 - c) for c in range(40)}
    assert store.detail(spark, name, "nobody").count() == 0
    # One file is all it opens: the others may be gone.
    file, = (r.f for r in spark.table(name).filter("cluster_id = 'c7'").select(F.input_file_name().alias("f")).distinct().collect())
    folder = os.path.dirname(file.removeprefix("file:").replace("///", "/"))
    others = [f for f in os.listdir(folder) if f.endswith(".parquet") and f != os.path.basename(file)]
    for f in others:
        os.remove(os.path.join(folder, f))
    assert len(others) == 7 and store.detail(spark, name, "c7").count() == 100
    spark.sql(f"DROP TABLE {name}")


def test_feature_statistics(spark):
    from tracewright.functions import scalars

    df = spark.createDataFrame([(1, "a", "x", None), (2, "a", None, None), (3, "b", "y", None)], "line_idx long, `user.name` string, verb string, never string")
    got = {r.feature: (r.n, r.known, r.often) for r in scalars.feature_stats(df, top=1).collect()}
    assert got == {"user.name": (2, 3, ["a"]), "verb": (2, 2, ["x"])}
    assert scalars.feature_stats(df).columns == ["feature", "n", "known"]
