"""Shared plumbing of the text operators: session settings, shared storage, byte-level word scanning."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, stored  # noqa: F401 (the operators take them from here)

#: Bytes of text that one group of the chunked operators holds, and the fewest groups.
CHUNK_BYTES, LEAST_CHUNKS = 8 << 20, 64
#: Bytes that numpy scans at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch; documents are a few kB each.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, or one row.
BATCH_BYTES = "16m"

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and tab to carriage return separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Batches of a bounded number of rows and bytes, in this session from now on; executors get this package where it isn't installed."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def unused(docs: DataFrame, name: str) -> str:
    """The name, with marks behind it until no column of docs is called so (names don't tell cases apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunk_count(docs: DataFrame) -> int:
    """Groups such that one holds about CHUNK_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_CHUNKS, math.ceil(total / CHUNK_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column of an Arrow batch or table."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: The lowest k bytes of a word of eight.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


class Words:
    """Words of consecutive documents, in lower case: start, end (byte positions), doc (index)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE):
        n = len(buf)
        low = np.zeros(n + 8, np.uint8)
        np.take(LOWER, buf, out=low[:n])
        #: The eight bytes from each position on, as one number.
        self.eight = np.ndarray((n + 1,), "<u8", low.data, strides=(1,))
        self.off, inside = off, ~separator[low[:n]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = off[:-1][off[:-1] < off[1:]]
        first[cut] = inside[cut]
        ends = off[1:][off[:-1] < off[1:]] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        #: Words of document i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, off)

    def blocks(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes from start to end, eight at a time and zeros behind; each block's place in its span; each span's first block."""
        many = np.maximum(1, (end - start + 7) >> 3)
        begin = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(start)), many)
        place = np.arange(len(owner)) - begin[owner]
        at = start[owner] + 8 * place
        return self.eight[at] & MASKS[np.minimum(end[owner] - at, 8)], place, begin

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the lower-cased bytes from start to end: each block of eight is mixed with its place, then all are added."""
        if not len(start):
            return np.zeros(0, U)
        value, place, begin = self.blocks(start, end)
        return mix(np.add.reduceat(mix(value + (place + 1).astype(U) * C1), begin) + (end - start).astype(U) * C3)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def same(self, other: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of the word that other names for it."""
        ok = self.end - self.start == (self.end - self.start)[other]
        k = np.flatnonzero(ok)
        if len(k):
            value, _, begin = self.blocks(self.start[k], self.end[k])
            ok[k] = np.logical_and.reduceat(value == self.blocks(self.start[other[k]], self.end[other[k]])[0], begin)
        return ok


def each_slice(buf: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in slices(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies: in the installed package of vocabularies, or in /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
