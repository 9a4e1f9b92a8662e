"""Token counts of documents in flat token files without an index, by a separator scan.

A flat file is a run of 16- or 32-bit ids in which an end-of-document id closes each document. It is read in
blocks. Each block is searched for that id at once; what it gives is the places of its separators and its
size. Blocks of a file are then stitched by a prefix scan: a running sum of separators numbers the documents,
a running maximum of the last separator's place tells where the document that is open at a block's start
began. The scan has two levels, GROUP blocks and then groups, so that one file may hold any share of the ids.

The query writes every whole text of `documents` as flat blocks, one stream per partition, and counts them
again from the ids alone. Null and empty texts have 0 tokens. Rows with a null or repeated doc_id count on
their own. An empty table gives an empty result. What follows a file's last separator is a document that
isn't closed; scan() leaves it out, and open_tails() gives its size. Files are read in ranges, by as many
tasks as a file has ranges; bytes at a file's end that are no whole id are no token.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, flat, load, stored, tune
from .tokens import encoder

#: <|endoftext|> of the vocabulary; with plain=True no text gives it.
END = 49407
BLOCK = 1 << 16
#: Blocks that one task reads or stitches together.
GROUP = 1024
FLAT = "file string, block long, ids binary, first long, doc_ids array<long>"


def flat_blocks(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """The documents as flat streams, a stream per partition: rows of (file, block, ids).

    Beside them, rows of (file, first, doc_ids) keep which documents were written in which order.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
    last = np.array([END], "<u2").tobytes()

    def run(batches):
        encode, held, number, done, file = encoder(vocabulary, True), b"", 0, 0, None
        for b in batches:
            file = f"part-{b.column('part')[0].as_py():08d}" if b.num_rows else file
            held += b"".join(x + last for x in encode.many(*flat(b.column("text"))))
            full = len(held) // (2 * block)
            cuts = [held[2 * block * k : 2 * block * (k + 1)] for k in range(full)]
            held = held[2 * block * full :]
            ids = b.column("doc_id").to_pylist()
            yield as_batch(schema, file=[file] * (full + 1), block=[*range(number, number + full), None], ids=[*cuts, None], first=[None] * full + [done], doc_ids=[None] * full + [ids])
            number, done = number + full, done + len(ids)
        if held:
            yield as_batch(schema, file=[file], block=[number], ids=[held], first=[None], doc_ids=[None])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, FLAT)


def opened(path: str) -> pa.NativeFile:
    """A file as Spark names it, for reads at any place; Arrow's own file systems know file, hdfs, s3, gs and abfs."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    files, name = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + ":" + urllib.parse.quote(rest, safe="/:@"))
    return files.open_input_file(name)


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK, opener: Callable = opened) -> DataFrame:
    """Flat files of little-endian ids of that many bytes, as (file, block, ids).

    Spark lists the files and their sizes; ranges of GROUP blocks are dealt to tasks, which read block by block
    from what opener(path) gives (anything with read_at(bytes, offset)).
    """
    tune(spark)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.binary())])
    size = width * block
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") - F.col("length") % width).alias("bytes")).filter("bytes > 0")
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {size * GROUP}"))).alias("range"))
    total = files.agg(F.sum(F.expr(f"(bytes - 1) div {size * GROUP} + 1"))).first()[0] or 1

    def run(batches):
        for b in batches:
            for name, length, r in zip(*(b.column(k).to_pylist() for k in ("path", "bytes", "range"))):
                with opener(name) as f:
                    for k in range(r * GROUP, min((r + 1) * GROUP, -(-length // size))):
                        yield as_batch(schema, file=[name], block=[k], ids=[f.read_at(min(size, length - k * size), k * size)])

    return ranges.repartition(min(total, 32 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "file string, block long, ids binary")


def summaries(blocks: DataFrame, end: int, width: int) -> DataFrame:
    """Of each block: ids, and the places of its separators."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in b.column("ids")]
            yield as_batch(schema, file=b.column("file"), block=b.column("block"), n=[len(x) for x in ids], ends=[np.flatnonzero(x == end) for x in ids])

    return blocks.select("file", "block", "ids").mapInArrow(run, "file string, block long, n long, ends array<int>")


def stitched(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """The blocks' summaries with, by prefix scan, the ids and documents before each and where its first document began."""
    found = stored(blocks.sparkSession, summaries(blocks, end, width).withColumn("group", F.expr(f"block div {GROUP}")), "ends")
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.withColumn("ids_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    closed = F.when(F.size("ends") > 0, F.col("ids_before") + F.element_at("ends", -1) + 1)
    inside = inside.withColumn("closed", closed).withColumn("ends_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("last_before", F.max("closed").over(before))
    totals = inside.groupBy("file", "group").agg(F.sum("n").alias("group_ids"), F.sum(F.size("ends")).alias("group_ends"), F.max("closed").alias("group_closed"))
    groups = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("group_ids").over(groups), F.lit(0))).select(
        "file", "group", "base", F.coalesce(F.sum("group_ends").over(groups), F.lit(0)).alias("base_ends"), F.coalesce(F.max(F.col("base") + F.col("group_closed")).over(groups), F.lit(0)).alias("base_began")
    )
    return inside.join(bases, ["file", "group"]).select(
        "file", "block", "n", "ends", (F.col("base") + F.col("ids_before")).alias("at"), (F.col("base_ends") + F.col("ends_before")).cast("long").alias("documents"),
        F.coalesce(F.col("base") + F.col("last_before"), F.col("base_began")).alias("began"),
    )


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """file, document (its number in the file, from 0), n_tokens (without the separator)."""
    places = F.transform("ends", lambda x: x + F.col("at"))
    starts = F.concat(F.array("began"), F.transform("places", lambda x: x + 1))
    out = stitched(blocks, end, width).filter(F.size("ends") > 0).withColumn("places", places)
    return out.select("file", "documents", F.posexplode(F.zip_with("places", F.slice(starts, 1, F.size("places")), lambda a, b: a - b))).select("file", (F.col("documents") + F.col("pos")).alias("document"), F.col("col").cast("long").alias("n_tokens"))


def open_tails(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """file, n_tokens after its last separator, where there are some."""
    every = stitched(blocks, end, width).withColumn("stop", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1) + 1).otherwise(F.col("began")))
    return every.groupBy("file").agg((F.max(F.col("at") + F.col("n")) - F.max("stop")).alias("n_tokens")).filter("n_tokens > 0")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document, counted from flat blocks."""
    flat_rows = stored(docs.sparkSession, flat_blocks(docs, vocabulary), "flat")
    counted = scan(flat_rows.filter(F.col("ids").isNotNull()))
    order = flat_rows.filter(F.col("doc_ids").isNotNull()).select("file", "first", F.posexplode("doc_ids")).select("file", (F.col("first") + F.col("pos")).alias("document"), F.col("col").alias("doc_id"))
    return order.join(counted, ["file", "document"]).select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
