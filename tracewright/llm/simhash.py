"""Near duplicates by SimHash fingerprints, linked through multi-index hashing.

A fingerprint has a bit where over half of the hashes (XXH64, seed 42) of a text's three-word shingles have it, repeats counted. Equal
fingerprints are one class. Two classes are linked if they differ in at most two bits. A fingerprint is filed in two tables, by its
upper and by its lower 32 bits. If two of them differ by two bits or fewer, then either their upper segments differ
by at most one, or their lower segments are equal: so each looks up the Hamming ball of radius one around its upper
segment and of radius zero around its lower one, and what the tables give is verified by the complete distance. Of two
segments that differ in a bit, the one without it looks up the other.

A segment that more than HOT fingerprints share would be compared pair by pair. These fingerprints, and all whose
balls reach such a segment, are filed under their balls of radius one within either segment beside the other segment as it is,
65 points each: two fingerprints are within two bits exactly if they meet at a point, and at most 65 can. So neither
table has a key with more than HOT rows, and the work is in proportion to the number of fingerprints.

Links are contracted to components by alternating stars. A null text, or one without words, has the fingerprint zero, which is linked like
any other. Rows that repeat a doc_id are fingerprinted each by its own text. A null doc_id is never a component's
name unless none has a doc_id (component_id is null then). An empty table gives an empty result. Other columns play
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, as_batch, each_slice, flat, load, stored, tune, unused
from .near_dedup import components

WORDS, SEED, MOST_BITS = 3, 42, 2
#: Fingerprints that may share a segment and still be compared one by one.
HOT = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
LOW = (1 << 32) - 1


def joined_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts in lower case with one space behind each; where each begins and ends; each text's first word."""
    low = LOWER[buf]
    inside = ~SPACE[low]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    full = off[:-1] < off[1:]
    cut, ends = off[:-1][full], off[1:][full] - 1
    first[cut], last[ends] = inside[cut], inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[inside]
    return out, at, at + size, np.searchsorted(start, off)


def fingerprints_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of each of the UTF-8 texts, unsigned."""
    data, begin, end, first = joined_words(buf, off)
    data, many = data.tobytes(), np.diff(first)
    # Text d has max(1, words - 2) shingles, none without words; a shingle ends with its third word, or with the text.
    n = np.where(many > 0, np.maximum(many - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    head = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    tail = np.minimum(head + WORDS, first[1:][doc]) - 1
    digest, count = xxhash.xxh64_intdigest, np.zeros((len(n), 64), np.int64)
    for a in range(0, len(doc), BLOCK):
        b = min(a + BLOCK, len(doc))
        h = np.array([digest(data[i:j], SEED) for i, j in zip(begin[head[a:b]].tolist(), end[tail[a:b]].tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.append(True, doc[a + 1 : b] != doc[a : b - 1]))
        count[doc[a:b][cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * count > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed integer, of each row."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j, part, cut in each_slice(*flat(batch.column("text"))):
                yield as_batch(schema, doc_id=batch.column("doc_id").slice(i, j - i), fp=fingerprints_of(part, cut).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def close_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, w) that connect all fingerprints (fp, each once) that differ in at most MOST_BITS bits."""
    spark = fps.sparkSession
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    bit = [F.lit(1 << j).cast("long") for j in range(32)]
    filed = fps.select("fp", F.inline(F.array(F.struct(F.lit(1).alias("part"), upper.alias("segment")), F.struct(F.lit(2).alias("part"), lower.alias("segment")))))
    common = stored(spark, filed.groupBy("part", "segment").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > hot).select("part", "segment"), "common")
    cold = filed.join(common, ["part", "segment"], "left_anti")
    # What is filed under a segment that few share looks up the ball around it; of a pair the smaller one under the same segment.
    ball = F.array(F.struct(F.lit(True).alias("same"), F.col("segment").alias("key")), *[F.struct(F.lit(False).alias("same"), F.when((F.col("part") == 1) & (F.col("segment").bitwiseAND(b) == 0), F.col("segment").bitwiseOR(b)).alias("key")) for b in bit])
    asked = cold.select("part", F.col("fp").alias("u"), F.inline(ball)).filter("key IS NOT NULL")
    found = asked.join(cold.select("part", F.col("segment").alias("key"), F.col("fp").alias("w")), ["part", "key"]).filter((distance("u", "w") <= MOST_BITS) & (~F.col("same") | (F.col("u") > F.col("w")))).select("u", "w")
    # Fingerprints whose ball reaches a common segment meet at points instead.
    around = F.array(F.col("segment"), *[F.when(F.col("part") == 1, F.col("segment").bitwiseXOR(b)) for b in bit])
    reached = common.select("part", F.explode(around).alias("segment")).filter("segment IS NOT NULL").distinct()
    wide = filed.join(reached, ["part", "segment"], "left_semi").select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63)).cast("long")) for j in range(64)])
    met = wide.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 at most
    at_points = met.select(F.explode("all").alias("u"), F.array_min("all").alias("w")).filter((F.col("u") != F.col("w")) & (distance("u", "w") <= MOST_BITS))
    return found.unionByName(at_points)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    spark = docs.sparkSession
    rows = stored(spark, fingerprinted(docs), "fingerprints")
    classes = stored(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "classes")
    labels = components(close_fingerprints(classes.select("fp")))
    labels = labels.unionByName(labels.select(F.col("component").alias("v"), "component").distinct())
    named = stored(spark, classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "doc", F.coalesce("component", "fp").alias("component")), "named")
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    told = named.join(first, "component").select("fp", "component_id")
    return rows.join(told, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component (the one with the smallest doc_id; of rows that repeat it, all) with all its columns; rows without a doc_id stay."""
    other = unused(docs, "gone_id")
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("NOT kept").select(F.col("doc_id").alias(other))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(other), "left_anti")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
