"""Repeated runs of lines by a suffix array over line-ID sequences, built by distributed prefix doubling.

Every document is a sequence of line IDs. A round of doubling names the prefixes of twice the length: pairs of
names, the second so many lines further on, are sorted by range over the whole cluster and numbered in that
order, so that names compare as the suffixes do. Names are given to repeated prefixes only; what occurs once
has found its place in the suffix array and drops out, with everything longer that contains it. Rounds go on
until no prefix repeats. A name of a round is an LCP interval: the suffixes that agree on so many lines or
more. In each interval the first suffix by (doc_id, line) stays; a later one is a copy of it. The deepest
interval in which a suffix is a later one, found exactly by going down through the doublings again, gives the run that
starts there: the first suffix is where the run is kept, and neighbouring suffixes whose copies lie on the same
diagonal join into maximal repeated runs.

Later copies go where they are runs of LEAST lines or more, or single lines of LONG characters or more.

Lines end at line feeds and are compared as they are. Null texts are one empty line, as empty ones are.
A null doc_id comes after every other; rows that repeat a doc_id count on their own, in an order that is
settled when the rows are stored. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored

#: Lines of a run from which its later copies go, and characters of a line from which it is a run by itself.
LEAST, LONG = 2, 100


def lines_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows (row, doc_id, text), and (row, doc_id, n, long, key) of each line."""
    spark = docs.sparkSession
    base = stored(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    every = base.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return base, every.select("row", "doc_id", F.col("n").cast("long").alias("n"), (F.length("line") >= LONG).alias("long"), F.unhex(F.md5("line")).alias("key"))


def named(rows: DataFrame, key: list[str], *keep: str) -> DataFrame:
    """The rows (row, doc_id, n, keep) whose key occurs twice or more, with a name that compares as the key does and the place first that has it."""
    spark = rows.sparkSession
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("n"))
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first")).filter("size > 1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = repeated.repartitionByRange(parts, *key).sortWithinPartitions(*key).select(*key, F.monotonically_increasing_id().alias("name"), F.struct("first.row", "first.n").alias("first"))
    return rows.join(stored(spark, names, "names"), key).select("row", "doc_id", "n", *keep, "name", "first")


def doubled(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """(size, rows) for sizes 1, 2, 4, ...: the suffixes whose first `size` lines occur again, until none do. Rows: row, doc_id, n, long, name, first."""
    spark = lines.sparkSession
    size, levels = 1, [(1, stored(spark, named(lines, ["key"], "long"), "prefixes"))]
    while not levels[-1][1].isEmpty():
        found = levels[-1][1]
        further = found.select("row", (F.col("n") - size).alias("n"), F.col("name").alias("next"))
        pairs = found.join(further, ["row", "n"]).select("row", "doc_id", "n", "long", F.col("name").alias("left"), "next")
        size *= 2
        levels.append((size, stored(spark, named(pairs, ["left", "next"], "long"), "prefixes")))
    return levels


def later_copies(levels: list[tuple[int, DataFrame]], least: int) -> DataFrame:
    """(row, n, size, first) of the suffixes that aren't the first of an interval, for each interval of `least` lines at least or one long line."""
    later = (F.col("row") != F.col("first.row")) | (F.col("n") != F.col("first.n"))
    parts = [rows.filter(later if size >= least else later & F.col("long") & (size == 1)).select("row", "n", F.lit(size).cast("long").alias("size"), "first") for size, rows in levels if size == 1 or size >= least]
    return reduce(DataFrame.unionByName, parts)


def exact_levels(lines: DataFrame, least: int) -> list[tuple[int, DataFrame]]:
    """The levels of doubling and, where `least` isn't one of their sizes, that of `least` lines (two overlapping prefixes)."""
    levels = doubled(lines)
    below = [x for x in levels if x[0] < least <= 2 * x[0]]
    if below and 2 * below[0][0] != least:
        size, found = below[0]
        further = found.select("row", (F.col("n") - (least - size)).alias("n"), F.col("name").alias("next"))
        pairs = found.join(further, ["row", "n"]).select("row", "doc_id", "n", "long", F.col("name").alias("left"), "next")
        levels.append((least, stored(lines.sparkSession, named(pairs, ["left", "next"], "long"), "prefixes")))
    return levels


def longest_copies(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Of each suffix with an earlier copy: row, n, size (the most lines that an earlier suffix agrees on, exactly) and first, the first such suffix.

    A suffix starts from the deepest doubling in which it is a later copy and tries to grow by half of that, a quarter, and so on:
    of the suffixes with the same first one, those whose next lines have the same name grow together, if they aren't the first of
    these. That one stands for them from then on, and goes on growing for itself from where it was. So of each group
    there is one row more than there are copies.
    """
    levels = [(size, rows) for size, rows in levels if size & (size - 1) == 0]
    spark = levels[0][1].sparkSession
    later = (F.col("row") != F.col("first.row")) | (F.col("n") != F.col("first.n"))
    columns = ["row", "doc_id", "n", "start", "size", "first", "own"]
    every = reduce(DataFrame.unionByName, [rows.withColumn("start", F.lit(size).cast("long")).withColumn("own", later) for size, rows in levels])
    deepest = every.filter("own").groupBy("row", "n").agg(F.max("start").alias("start"))
    mine = every.filter("own").join(deepest, ["row", "n", "start"])
    stands = every.filter("NOT own").join(mine.select("start", "first").distinct(), ["start", "first"])
    entries = stored(spark, mine.unionByName(stands).withColumn("size", F.col("start")).select(*columns), "copies")
    for step, names in reversed(levels):
        growing = entries.filter(F.col("start") > step)
        following = names.select("row", F.col("n").alias("at"), F.col("name").alias("next"))
        near = growing.withColumn("at", F.col("n") + F.col("size")).join(following, ["row", "at"]).drop("at")
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("n"))
        groups = near.groupBy("first", "size", "next").agg(F.count(F.lit(1)).alias("many"), F.min(place).alias("least")).filter("many > 1")
        told = near.join(groups.select("first", "size", "next", F.struct("least.row", "least.n").alias("new")), ["first", "size", "next"])
        grown = stored(spark, told.select("row", "doc_id", "n", "start", (F.col("size") + step).alias("size"), F.col("new").alias("first"), ((F.col("row") != F.col("new.row")) | (F.col("n") != F.col("new.n"))).alias("own")), "grown")
        left = entries.join(grown.filter("own").select("row", "n", F.lit(True).alias("own")), ["row", "n", "own"], "left_anti")
        entries = stored(spark, left.select(*columns).unionByName(grown), "copies")
    return entries.filter("own").select("row", "n", "size", "first")


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The maximal repeated runs: row, doc_id, start, lines, and first_row, first_start, where their lines are kept.

    row numbers the rows of docs as they were stored; a run's copy is that many lines from first_start on in first_row.
    """
    base, lines = lines_of(docs)
    levels = doubled(lines)
    alone = later_copies(levels[:1], 2)  # single long lines
    found = longest_copies(levels).filter(F.col("size") >= least).unionByName(alone)
    longest = found.groupBy("row", "n").agg(F.max(F.struct("size", "first")).alias("d"))
    return runs_of(longest.select("row", "n", "d.size", "d.first")).join(base.select("row", "doc_id"), "row")


def runs_of(copies: DataFrame) -> DataFrame:
    """Neighbouring suffixes on one diagonal, joined: row, start, lines, first_row, first_start."""
    w = Window.partitionBy("row", "first.row", "diagonal").orderBy("n")
    reach = F.max(F.col("n") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = copies.withColumn("diagonal", F.col("n") - F.col("first.n")).withColumn("opens", F.coalesce((F.col("n") > reach).cast("int"), F.lit(1)))
    told = told.withColumn("run", F.sum("opens").over(w))
    out = told.groupBy("row", F.col("first.row").alias("first_row"), "diagonal", "run").agg(F.min("n").alias("start"), F.max(F.col("n") + F.col("size")).alias("stop"))
    return out.select("row", "start", (F.col("stop") - F.col("start")).alias("lines"), "first_row", (F.col("start") - F.col("diagonal")).alias("first_start"))


def removed_runs(copies: DataFrame) -> DataFrame:
    """row, start, stop of the maximal runs of lines that some copy covers; a window holds one document's."""
    w = Window.partitionBy("row").orderBy("n", "size")
    reach = F.max(F.col("n") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = copies.withColumn("opens", F.coalesce((F.col("n") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(w))
    return told.groupBy("row", "run").agg(F.min("n").alias("start"), F.max(F.col("n") + F.col("size")).alias("stop")).drop("run")


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs (maximal removed runs), longest_run (lines), text (what is left)."""
    base, lines = lines_of(docs)
    gone = removed_runs(later_copies(exact_levels(lines, least), least))
    by_row = gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    out = base.join(by_row, "row", "left").withColumn("gone", F.coalesce("gone", none)).withColumn("lines", F.split("text", "\n"))
    size = F.size("lines").cast("long")
    # What stays lies before the first removed run, between two, and after the last.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda g: g["stop"]))
    stops = F.concat(F.transform("gone", lambda g: g["start"]), F.array(size))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.slice("lines", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    lost = F.transform("gone", lambda g: g["stop"] - g["start"])
    removed = F.aggregate(lost, F.lit(0).cast("long"), lambda t, x: t + x)
    return out.select("doc_id", size.alias("n_lines"), removed.alias("n_removed"), F.size("gone").cast("long").alias("n_runs"), F.coalesce(F.array_max(lost), F.lit(0).cast("long")).alias("longest_run"), F.array_join(kept, "\n").alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(load(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM s),
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM l),
c AS (SELECT *, following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, n) > 1 AS later, length(line) >= 100 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS alone FROM w),
g AS (SELECT *, alone OR later OR coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY n), false) AS gone FROM c),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM g),
i AS (SELECT *, count_if(begins) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM r),
m AS (SELECT doc_id, max(size) AS longest_run FROM (SELECT doc_id, run, count(*) AS size FROM i WHERE gone GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed, CAST(count_if(begins) AS BIGINT) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.*, coalesce(longest_run, 0) AS longest_run FROM d LEFT JOIN m USING (doc_id)
"""
