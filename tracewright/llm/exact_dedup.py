"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame operations alone.

Each row goes to one of RUNS runs by a hash of its doc_id. A run holds one entry per digest: the smallest
identifier and the number of rows. Runs then merge FAN at a time, level by level, until one is left; a
level's entries are sorted by digest within their tasks and the smallest verified identifier of each digest
is kept. The winner goes back down the same tree, so no task ever sees more than FAN entries of one digest,
however many rows share it. Besides the digest an entry is keyed by the text's length and by a second,
independent hash: entries meet only where all three agree.

Null texts count as empty. A null doc_id counts as larger than every other. Rows that repeat both doc_id and
text are copies of each other: one of them is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored, unused

#: Runs, and how many merge into one at each level: powers of two, so that a run's parent is its number shifted right.
RUNS, SHIFT = 1024, 5
FAN = 1 << SHIFT
KEY = ["digest", "bytes", "check"]
#: Characters that count as white space.
BLANK = r"[\x20\x09-\x0D]+"


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, run and the key of every row's normalised text."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANK, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("check"), F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).alias("run")
    )


def tree_merge(rows: DataFrame) -> DataFrame:
    """One row per (key, run) of the rows: keep_id and group_size over all runs."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    entries = rows.groupBy(*KEY, "run").agg(smallest.alias("least"), F.count(F.lit(1)).alias("size"))
    levels, width = [entries], RUNS
    while width > 1:
        width = -(-width // FAN)
        up = levels[-1].withColumn("run", F.shiftright("run", SHIFT))
        levels.append(up.groupBy(*KEY, "run").agg(F.min("least").alias("least"), F.sum("size").alias("size")))
    won = levels.pop()
    for below in reversed(levels):
        won = below.select(*KEY, "run", F.shiftright("run", SHIFT).alias("up")).join(won.withColumnRenamed("run", "up"), [*KEY, "up"]).drop("up")
    return won.select(*KEY, "run", F.col("least.id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(docs.sparkSession, digested(docs), "digests")
    out = rows.join(tree_merge(rows), [*KEY, "run"])
    turn = F.row_number().over(Window.partitionBy(*KEY, "run", "doc_id").orderBy("doc_id"))
    return out.withColumn("turn", turn).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called; texts are shuffled once."""
    key, turn = unused(docs, "row_key"), unused(docs, "row_turn")

    def named(doc_id, sha):  # rows that agree in it are copies with the same identifier
        return F.concat(sha, F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))

    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANK, " ")
    marked = docs.withColumn(key, named(F.col("doc_id"), F.sha2(text, 256)))
    kept = exact_duplicates(docs).filter("kept").select(named(F.col("doc_id"), F.col("text_sha256")).alias(key))
    alone = marked.join(kept, key, "left_semi")
    return alone.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(turn) == 1).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256, doc_id) AS turn FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, (doc_id IS NOT DISTINCT FROM keep_id AND turn = 1) AS kept, text_sha256
FROM r JOIN g USING (text_sha256)
"""
