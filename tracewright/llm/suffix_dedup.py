"""Repeated passages by longest-previous-factor arrays: a byte goes if a LEAST-byte string over it also starts in an earlier document.

A suffix's longest previous factor is the longest prefix that it shares with a suffix of a document with a
smaller doc_id; its windows of LEAST bytes go where that reaches LEAST. To sort suffixes without moving them
all, each goes by its minimiser, the smallest hash of its first window's GRAM-byte substrings: suffixes that
share LEAST bytes have equal minimisers. Consecutive windows of a document under one minimiser form a segment
of at most WIDTH windows. Segments are resolved in two rounds, each by hash bucket:

1. Every chunk of documents sends its distinct segments, as 96 bits each (32 of the minimiser, others of which choose
   the bucket, and a 64-bit hash of the segment's bytes), with their smallest doc_id. A segment that as a whole occurs in an earlier document has a previous factor at each of its windows. One whose
   minimiser does, or one that others need to be compared with, is asked for.
2. The segments asked for are sent as text and their suffixes sorted byte by byte. The LCP array of that order
   and, for each suffix, the previous and the next one in it with a smaller doc_id give its longest previous
   factor: the larger of the two ranges' least LCPs (factors()). Factors end with the segment; those that go on
   are found again in the document's next segment. Each segment is told which of its windows reach LEAST.

A chunk sends a segment once however often it occurs there, so a passage that a third of all documents share is
one record a chunk. There is a bucket for BUCKET_CHUNKS chunks; a chunk's records to a bucket travel as one row.

Texts are judged as UTF-8 bytes; null texts are empty and lose nothing, as do texts shorter than LEAST. A null
doc_id counts as larger than every other; documents with the same doc_id are never matched with each other.
An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, C2, C3, LEAST_CHUNKS, U, as_batch, chunk_count, each_slice, flat, load, mix, stored, tune

LEAST, GRAM, WIDTH = 50, 20, 32
SPAN = LEAST - GRAM + 1
NONE = np.iinfo(np.int64).max
#: Chunks for each bucket: fewer buckets make larger rows.
BUCKET_CHUNKS = 2

SENT = "bucket int, chunk int, keys binary, docs binary, lengths binary, strings binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("strings", pa.binary())])
TOLD = "chunk int, bucket int, whole binary, asked binary, at binary, masks binary"
TOLD_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("whole", pa.binary()), ("asked", pa.binary()), ("at", pa.binary()), ("masks", pa.binary())])


def loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as a word; places near the end see zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def window_hash(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = np.zeros(len(at), U)
    for k in (*range(0, LEAST - 8, 8), LEAST - 8):
        x = (x ^ eight[at + k]) * C1
        x ^= x >> U(32)
    return mix(x)


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last window, minimiser and hash of each segment."""
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < LEAST:
        return none, none, none, none.astype(U), none.astype(U)
    eight = loads(buf)
    grams = n - GRAM + 1
    x = eight[:grams] * C1
    x ^= x >> U(32)
    x += eight[8 : 8 + grams]
    x *= C2
    x ^= x >> U(29)
    x += eight[GRAM - 8 : GRAM - 8 + grams]
    x *= C3
    x ^= x >> U(32)
    size = 1
    while size * 2 <= SPAN:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    least = np.minimum(x[: len(x) - (SPAN - size)], x[SPAN - size :])
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, off[:-1], 1)
    np.add.at(inside, np.maximum(off[:-1], off[1:] - LEAST + 1), -1)
    at = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(at):
        return none, none, none, none.astype(U), none.astype(U)
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    runs = np.flatnonzero(new)
    long = np.diff(np.append(runs, len(at)))
    if long.max() > WIDTH:
        for r, m in zip(runs[long > WIDTH], long[long > WIDTH]):
            new[r : r + m : WIDTH] = True
        runs = np.flatnonzero(new)
    first, last = at[runs], at[np.append(runs[1:], len(at)) - 1]
    whole = mix(window_hash(eight, first) + mix(window_hash(eight, last) + (last - first).astype(U) * C2))
    return np.searchsorted(off, first, "right") - 1, first, last, mix(least[runs]), whole  # smallest hashes crowd near 0 until mixed


def settled(table: pa.Table) -> pa.Table:
    """The rows by doc_id, null last, then by text: the same order whatever order they came in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if repeats(table.column("doc_id")) else table.sort_by("doc_id")


def repeats(column) -> bool:
    return column.null_count > 1 or len(column.unique()) < len(column)


class Chunk:
    """The segments of a chunk's documents, by doc_id, and its distinct records, in an order that only their content decides."""

    def __init__(self, table: pa.Table, buckets: int):
        self.table = table = settled(table)
        self.buf, self.off = flat(table.column("text"))
        self.docs = table.column("doc_id").combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [(i, off[0] + self.off[i], segments(b, off)) for i, _, b, off in each_slice(self.buf, self.off)]
        self.doc, self.first, self.last, gram, key = (np.concatenate([np.zeros(0, np.int64 if k < 3 else U), *(p[2][k] + (p[0] if k == 0 else p[1] if k < 3 else U(0)) for p in parts)]) for k in range(5))
        self.owner = self.docs[self.doc]
        order = np.argsort(mix(gram * C1 + key), kind="stable")  # equal ones keep the documents' order
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (gram[order][1:] != gram[order][:-1])
        some = order[new]  # of each (gram, key) the segment in the smallest document
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        by_place = np.argsort(some)
        bucket = ((gram[some[by_place]] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")  # by bucket, then document
        sent = by_place[dealt]
        self.records = some[sent]
        rank = np.empty(len(some), np.int64)
        rank[sent] = np.arange(len(some))
        self.record = rank[group]  # of each segment
        self.least_doc = self.owner[self.records]
        self.gram, self.key = gram[self.records].astype(np.uint32), key[self.records]
        self.bounds = np.searchsorted(bucket[dealt], np.arange(buckets + 1))

    def told(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """whole, asked, mask of each record."""
        n = len(self.records)
        whole, asked, mask = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint32)
        for r in table.to_pylist():
            lo, hi = self.bounds[r["bucket"]], self.bounds[r["bucket"] + 1]
            if r["whole"] is not None:
                whole[lo:hi] = np.unpackbits(np.frombuffer(r["whole"], np.uint8), count=hi - lo)
                asked[lo:hi] = np.unpackbits(np.frombuffer(r["asked"], np.uint8), count=hi - lo)
            else:
                mask[lo + np.frombuffer(r["at"], np.uint32)] |= np.frombuffer(r["masks"], np.uint32)
        return whole, asked, mask


def packed_docs(docs: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, so that the shuffle's compression works on them."""
    return np.diff(docs.view(U), prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_docs(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U).view(np.int64)


def send_hashes(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, buckets)
        full = np.flatnonzero(np.diff(chunk.bounds))
        cuts = [(chunk.bounds[b], chunk.bounds[b + 1]) for b in full]
        number = table.column("chunk")[0].as_py()
        none = [None] * len(full)
        return pa.Table.from_batches([as_batch(SENT_SCHEMA, bucket=full.astype(np.int32), chunk=[number] * len(full), keys=[chunk.gram[a:b].tobytes() + chunk.key[a:b].tobytes() for a, b in cuts], docs=[packed_docs(chunk.least_doc[a:b]) for a, b in cuts], lengths=none, strings=none)])

    return run


def starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups start, and the group of each row."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def changes(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def resolve_hashes(table: pa.Table) -> pa.Table:
    """Of a bucket's records: which are matches as a whole, which are asked for."""
    rows = table.to_pylist()
    sizes = [len(r["keys"]) // 12 for r in rows]
    gram = np.concatenate([np.frombuffer(r["keys"], np.uint32, n) for r, n in zip(rows, sizes)])
    key = np.concatenate([np.frombuffer(r["keys"], U, n, 4 * n) for r, n in zip(rows, sizes)])
    doc = np.concatenate([unpacked_docs(r["docs"]) for r in rows])
    order = np.lexsort((doc, key, gram))
    g, k, d = gram[order], key[order], doc[order]
    at, group = starts(changes(g) | changes(k))
    least_same = d[at][group]
    at, group = starts(changes(g))
    least_gram = np.minimum.reduceat(d, at)[group] if len(d) else d
    match = d > least_same
    open_ = ~match & (d > least_gram)
    asked = np.logical_or.reduceat(open_, at)[group] & ~match if len(d) else open_
    back = np.empty((2, len(key)), bool)
    back[0][order], back[1][order] = match, asked
    out = [(r["chunk"], r["bucket"], np.packbits(back[0][e - n : e]).tobytes(), np.packbits(back[1][e - n : e]).tobytes()) for r, n, e in zip(rows, sizes, np.cumsum(sizes))]
    none = [None] * len(out)
    return pa.Table.from_batches([as_batch(TOLD_SCHEMA, chunk=[o[0] for o in out], bucket=[o[1] for o in out], whole=[o[2] for o in out], asked=[o[3] for o in out], at=none, masks=none)])


def send_strings(buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SENT_SCHEMA.empty_table()
        chunk = Chunk(table, buckets)
        _, asked, _ = chunk.told(told)
        at = np.flatnonzero(asked)
        segment = chunk.records[at]
        size = (chunk.last - chunk.first)[segment] + LEAST
        begin = np.cumsum(size) - size
        data = chunk.buf[np.repeat(chunk.first[segment] - begin, size) + np.arange(size.sum())] if len(at) else np.zeros(0, np.uint8)
        bucket = np.searchsorted(chunk.bounds, at, "right") - 1
        full = np.unique(bucket)
        cuts = list(zip(np.searchsorted(bucket, full), np.searchsorted(bucket, full, "right")))
        number = table.column("chunk")[0].as_py()
        edge = np.append(begin, size.sum())
        return pa.Table.from_batches([as_batch(SENT_SCHEMA, bucket=full.astype(np.int32), chunk=[number] * len(full), keys=[(at[a:b] - chunk.bounds[f]).astype(np.uint32).tobytes() for f, (a, b) in zip(full, cuts)], docs=[packed_docs(chunk.least_doc[at[a:b]]) for a, b in cuts], lengths=[size[a:b].astype(np.uint8).tobytes() for a, b in cuts], strings=[data[edge[a] : edge[b]].tobytes() for a, b in cuts])])

    return run


def suffix_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows that are cut into big-endian 8-byte words."""
    return np.lexsort(words[::-1])


def common_prefixes(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The LCP array: bytes that each suffix shares with the one before it in the order; 0 for the first."""
    lcp, going = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for w in words:
        differ = w[order[going]] ^ w[order[going - 1]]
        same = differ == 0
        some = differ[~same]
        bits = np.zeros(len(some), np.int64)  # zero bits above the highest one
        for k in (32, 16, 8):
            high = some >> U(64 - k) == 0
            bits += k * high
            some = np.where(high, some << U(k), some)
        lcp[going[same]] += 8
        lcp[going[~same]] += bits // 8
        going = going[same]
        if not len(going):
            break
    return lcp


def previous_smaller(value: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the nearest place before it with a smaller value, and the least lcp on the way; -1 where lcp falls below least.

    lcp[i]: what i shares with i - 1. By jumps over what was passed already: a place that isn't smaller has
    only larger ones between itself and where it has got to.
    """
    n = len(value)
    at, shared = np.arange(n) - 1, lcp.copy()
    going = np.arange(n)
    done = at < 0
    while True:
        stop = (at[going] < 0) | (shared[going] < least)
        at[going[stop]] = -1
        going = going[~stop]
        going = going[value[at[going]] >= value[going]]
        if not len(going):
            break
        step = at[going]
        shared[going] = np.minimum(shared[going], np.where(at[step] < 0, 0, shared[step]))
        at[going] = at[step]
    done = at < 0
    shared[done] = 0
    return at, shared


def factors(words: list[np.ndarray], size: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The longest previous factor of each suffix (words, padded with zeros; size bytes) in a document with a smaller number; 0 below least."""
    order = suffix_order(words)
    lcp, d, n = common_prefixes(words, order), doc[order], size[order]
    back, one = previous_smaller(d, lcp, least)
    ahead, two = previous_smaller(d[::-1], np.append(0, lcp[1:][::-1]) if len(lcp) else lcp, least)
    ahead, two = len(d) - 1 - ahead[::-1], two[::-1]
    one = np.where(back >= 0, np.minimum(one, np.minimum(n, n[back])), 0)
    two = np.where(ahead < len(d), np.minimum(two, np.minimum(n, n[np.minimum(ahead, len(d) - 1)])), 0)
    found = np.empty(len(d), np.int64)
    found[order] = np.maximum(one, two)
    return np.where(found >= least, found, 0)


def resolve_strings(table: pa.Table) -> pa.Table:
    """Of the strings of a bucket: a mask of the windows whose longest previous factor reaches LEAST."""
    rows = table.to_pylist()
    buf = np.frombuffer(b"".join(r["strings"] for r in rows), np.uint8)
    size = np.concatenate([np.frombuffer(r["lengths"], np.uint8) for r in rows]).astype(np.int64)
    doc = np.concatenate([unpacked_docs(r["docs"]) for r in rows])
    begin, windows = np.cumsum(size) - size, size - LEAST + 1
    edge = np.cumsum(windows) - windows
    record = np.repeat(np.arange(len(size)), windows)
    number = np.arange(len(record)) - edge[record]
    at, left = begin[record] + number, size[record] - number
    eight = loads(np.concatenate([buf, np.zeros(WIDTH + LEAST, np.uint8)]))
    words = []
    for k in range(0, LEAST + WIDTH - 1, 8):
        w = eight[at + k].byteswap()
        over = np.clip(k + 8 - left, 0, 8) * 8  # bits that lie beyond the segment
        words.append(np.where(over >= 64, U(0), w >> np.minimum(over, 63).astype(U) << np.minimum(over, 63).astype(U)))
    hit = np.flatnonzero(factors(words, left, doc[record]))
    mask = np.zeros(len(size), np.uint32)
    np.bitwise_or.at(mask, record[hit], np.uint32(1) << number[hit].astype(np.uint32))
    out, done = [], 0
    for r in rows:
        place = np.frombuffer(r["keys"], np.uint32)
        m = mask[done : done + len(place)]
        done += len(place)
        if m.any():
            out.append((r["chunk"], r["bucket"], place[m > 0].tobytes(), m[m > 0].tobytes()))
    none = [None] * len(out)
    return pa.Table.from_batches([as_batch(TOLD_SCHEMA, chunk=[o[0] for o in out], bucket=[o[1] for o in out], whole=none, asked=none, at=[o[2] for o in out], masks=[o[3] for o in out])])


def covered(chunk: Chunk, told: pa.Table) -> np.ndarray:
    """Which bytes of the chunk's texts go."""
    whole, _, mask = chunk.told(told)
    edges = np.zeros(len(chunk.buf) + 1, np.int32)
    later = chunk.owner > chunk.least_doc[chunk.record] if len(chunk.record) else np.zeros(0, bool)
    full = later | (whole[chunk.record] if len(chunk.record) else later)
    np.add.at(edges, chunk.first[full], 1)
    np.add.at(edges, chunk.last[full] + LEAST, -1)
    part = np.flatnonzero(~full & (mask[chunk.record] > 0)) if len(chunk.record) else np.zeros(0, np.int64)
    bits = mask[chunk.record[part]]
    for k in range(WIDTH):
        hit = chunk.first[part[(bits >> np.uint32(k)) & np.uint32(1) > 0]] + k
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + LEAST, -1)
    return np.cumsum(edges[:-1]) > 0


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("longest_span", pa.int64()), ("text", pa.string())])


def results(buckets: int, keep_text: bool):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        chunk = Chunk(table, buckets)
        gone = covered(chunk, told)
        rows = []
        for a, b in zip(chunk.off[:-1], chunk.off[1:]):
            g = gone[a:b]
            n = int(g.sum())
            kept = (chunk.buf[a:b][~g] if n else chunk.buf[a:b]).tobytes()
            runs = np.diff(np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))))[::2] if n else np.zeros(0, np.int64)
            rows.append((int(b - a), n, len(runs), hashlib.sha256(kept).hexdigest(), int(runs.max(initial=0)), kept.decode(errors="replace") if keep_text else None))
        return pa.Table.from_batches([as_batch(OUT, doc_id=chunk.table.column("doc_id").combine_chunks(), **{n: [r[k] for r in rows] for k, n in enumerate(OUT.names[1:])})])

    return run


def repeated_passages(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_span (bytes), and text (what is left) if asked for."""
    spark = docs.sparkSession
    tune(spark)
    chunks = chunk_count(docs)
    buckets = max(LEAST_CHUNKS, chunks // BUCKET_CHUNKS)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int"))
    hashes = dealt.groupBy("chunk").applyInArrow(send_hashes(buckets), SENT)
    first = stored(spark, hashes.groupBy("bucket").applyInArrow(resolve_hashes, TOLD), "hashes")
    strings = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_strings(buckets), SENT)
    second = strings.groupBy("bucket").applyInArrow(resolve_strings, TOLD)
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_span long, text string"
    out = dealt.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(results(buckets, keep_text), shape)
    return out if keep_text else out.drop("text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"))


#: Every LEAST-byte string (by its MD5) with the smallest doc_id that it starts in, over hexadecimal texts: two digits a byte.
SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE w.doc_id > f.first),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, string_agg(substr(t.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS rest, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, CAST(max(b - a) AS BIGINT) AS longest_span FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * rest + 1), h))) AS kept_sha256, coalesce(longest_span, 0) AS longest_span
FROM t LEFT JOIN kept USING (doc_id)
"""
