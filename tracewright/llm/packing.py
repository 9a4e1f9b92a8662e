"""Concatenate and cut: documents as one stream of token ids, cut into windows of LENGTH ids.

First pass: each partition writes its documents' ids to the shared folder, with the ids before each document
in that partition. The partitions' totals (one number each) are summed up to global offsets. Second pass: the
stored ids are read with their global offset and cut where the stream's windows end; a document that crosses
a boundary gives a piece on either side. Only the last sequence is padded.

A document is its ids and then END. Null and empty texts are END alone. Rows with a null or repeated doc_id
are documents of their own. An empty table gives no pieces. Order within the stream follows the partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, flat, load, stored, tune
from .tokens import encoder

LENGTH, END = 4096, 2
TOKENS = "doc_id long, ids binary, n long, part int, before long"


def tokenised(docs: DataFrame, end: int = END, vocabulary: str | None = None, plain: bool = False) -> DataFrame:
    """doc_id, ids (16-bit, end included), n, the partition and the ids before the document in it."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])
    last = np.array([end], "<u2").tobytes()

    def run(batches):
        encode, before = encoder(vocabulary, plain), 0
        for b in batches:
            ids = [x + last for x in encode.many(*flat(b.column("text")))]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield as_batch(schema, doc_id=b.column("doc_id"), ids=ids, n=n, part=b.column("part"), before=starts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, TOKENS)


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    rows = stored(spark, tokenised(docs, END, vocabulary), "tokens")
    totals = dict(rows.groupBy("part").agg(F.sum("n")).collect())  # a number for each partition
    parts = sorted(totals)
    base = dict(zip(parts, np.cumsum([0, *(totals[p] for p in parts)]).tolist()))
    shared = spark.sparkContext.broadcast(base)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names] + ([("ids", pa.binary())] if keep_ids else []))

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in schema.names]
            for doc, ids, n, part, before in zip(*(b.column(k).to_pylist() for k in ("doc_id", "ids", "n", "part", "before"))):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                at, start = shared.value[part] + before, 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = wide[4 * start : 4 * (start + size)]
                    row = [doc, start, size, zlib.crc32(piece), n, at // length, at % length] + [piece] * keep_ids
                    for o, x in zip(out, row):
                        o.append(x)
                    start, at = start + size, at + size
            yield as_batch(schema, **dict(zip(schema.names, out)))

    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", ids binary" * keep_ids)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))
