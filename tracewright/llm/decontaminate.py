"""Benchmark decontamination by suffix arrays over the words of training shards.

A shard is a slice of documents, turned into word hashes. Its suffix array holds the suffixes that can matter,
in the order of their words: those whose first HEAD words start some test suffix (every suffix of a benchmark item,
cut at WINDOW words; an item of fewer words as a whole). Each test suffix whose head the shard has is found in it by
binary search, word by word; every occurrence is then extended to the longest verbatim match at that place, in
the document and in the item. A shard's work depends on its own words and on what it has of the benchmark, not on the
benchmark's size: heads are looked up in a table that is made once, beside a bit map.

The benchmark is hashed on executors and broadcast in blocks of at most BLOCK_WORDS words, one of which the driver
holds at a time; a task searches its shard in every block. Executors hold about 60 bytes for each word of the benchmark.

Null texts, of documents or items, have no words and match nothing; so do empty ones. Items with the same
item_id count once in n_items. A null item_id is written as the empty string. Rows that repeat a doc_id are
judged each on its own. Words are told apart by 64-bit hashes. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, U, Words, as_batch, each_slice, flat, load, mix, tune

WINDOW, HEAD = 10, 4
BLOCK_WORDS = 1 << 20
#: Bits of the map of heads, for each head.
SPARE = 8
#: A word is a run of ASCII letters, digits and every byte of a character beyond ASCII.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; as long as h, the last n - 1 entries have no meaning."""
    out = h.copy()
    for k in range(1, n):
        out[:-k] = mix(out[:-k] * C1 + h[k:])
    return out


class Heads:
    """The test suffixes of n words or, for n = HEAD, of at least HEAD: by the hash of their first n words."""

    def __init__(self, words: np.ndarray, places: np.ndarray, n: int):
        keys = rolled(words, n)[places] if len(places) else np.zeros(0, U)
        order = np.argsort(keys, kind="stable")
        self.n, self.places = n, places[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.mask = U((1 << max(10, (len(self.keys) * SPARE).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[self.keys & self.mask] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h where some head stands, and the places of the test suffixes that begin so."""
        key = rolled(h, self.n)
        at = np.flatnonzero(self.maybe[key & self.mask])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        ok = self.keys[k] == key[at]
        met = np.unique(k[ok])
        size = self.first[met + 1] - self.first[met]
        tests = np.repeat(self.first[met] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at[ok], self.places[tests]


class Block:
    """The words of some benchmark items: of each place its item, where that ends, and how long the test suffix there is (0: none)."""

    def __init__(self, items: list[str], words: list[np.ndarray]):
        self.items, self.words = items, np.concatenate([*words, np.zeros(0, U)])
        size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(size) - size
        self.item = np.repeat(np.arange(len(words), dtype=np.int32), size)
        self.end = (self.start + size)[self.item]
        left = self.end - np.arange(len(self.words))
        whole = np.minimum(size, WINDOW)[self.item]  # a window has so many words in this item
        self.size = np.where(left >= whole, whole, 0).astype(np.int8)
        self.heads = [Heads(self.words, np.flatnonzero(self.size == n) if n < HEAD else np.flatnonzero(self.size >= HEAD), n) for n in range(1, HEAD + 1) if (self.size == n).any() or n == HEAD]


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most limit words, or of one item; one at a time."""
    schema = pa.schema([("item", pa.string()), ("words", pa.binary())])

    def hashed(batches):
        for b in batches:
            buf, off = flat(b.column("text"))
            w = Words(buf, off, APART)
            h = w.hashes()
            yield as_batch(schema, item=b.column("item"), words=[h[a:e].tobytes() for a, e in zip(w.first[:-1], w.first[1:])])

    items, words, held = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(hashed, "item string, words binary").toLocalIterator():
        h = np.frombuffer(row.words, U)
        if held and held + len(h) > limit:
            yield Block(items, words)
            items, words, held = [], [], 0
        items.append(row.item)
        words.append(h)
        held += len(h)
    yield Block(items, words)


def suffix_array(h: np.ndarray, last: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at some places in the order of their first WINDOW words, and those words, 0 beyond the document's end."""
    at = some[:, None] + np.arange(WINDOW)
    words = np.where(at < last[some][:, None], h[np.minimum(at, len(h) - 1)], U(0))
    order = np.lexsort(words.T[::-1])
    return some[order], words[order]


def found(array: np.ndarray, tests: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each test suffix (its first `size` words count) the range of the sorted suffixes that begin so; one binary search a word for all of them."""
    lo, hi = np.zeros(len(tests), np.int64), np.zeros(len(tests), np.int64)
    group, of, going = np.zeros(len(array), np.int64), np.zeros(len(tests), np.int64), np.arange(len(tests))
    for k in range(WINDOW):
        letters, code = np.unique(array[:, k], return_inverse=True)
        want = np.minimum(np.searchsorted(letters, tests[going, k]), len(letters) - 1)
        known = letters[want] == tests[going, k]
        going, want = going[known], want[known]
        place = group * len(letters) + code  # rises with the place in the array
        key = of[going] * len(letters) + want
        a, b = np.searchsorted(place, key, "left"), np.searchsorted(place, key, "right")
        met = a < b
        going, a, b = going[met], a[met], b[met]
        ends = size[going] == k + 1
        lo[going[ends]], hi[going[ends]] = a[ends], b[ends]
        group = np.cumsum(np.append(False, place[1:] != place[:-1]))
        going, a = going[~ends], a[~ends]
        of[going] = group[a]
        if not len(going):
            break
    return lo, hi


def search(h: np.ndarray, last: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every occurrence of a test suffix: its place among the words h, its words, its place in the benchmark, the longest match from there.

    last[i]: where the document of word i ends.
    """
    none = np.zeros(0, np.int64)
    heads = [x.of(h) for x in block.heads] if len(h) and len(block.words) else []
    some = np.unique(np.concatenate([none, *(s for s, _ in heads)]))
    if not len(some):
        return none, none, none, none
    tests = np.concatenate([t for _, t in heads])
    array, words = suffix_array(h, last, some)
    size = block.size[tests].astype(np.int64)
    lo, hi = found(words, block.words[np.minimum(tests[:, None] + np.arange(WINDOW), len(block.words) - 1)], size)
    many = hi - lo
    at = array[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
    n, place = np.repeat(size, many), np.repeat(tests, many)
    long, going = n.copy(), np.arange(len(at))
    while len(going):
        ok = (at[going] + long[going] < last[at[going]]) & (place[going] + long[going] < block.end[place[going]])
        going = going[ok]
        going = going[h[at[going] + long[going]] == block.words[place[going] + long[going]]]
        long[going] += 1
    return at, n, place, long


class Found:
    """What a slice of documents has of the benchmark. words: of each document; marks: which words are hit; items: names by document; matches: rows."""

    def __init__(self, part: np.ndarray, cut: np.ndarray, benchmark: list, locate: bool):
        w = Words(part, cut, APART)
        h, docs = w.hashes(), len(cut) - 1
        last = w.first[1:][w.doc]
        edges, self.items, self.matches = np.zeros(len(h) + 1, np.int64), {}, []
        for shared in benchmark:
            block = shared.value
            at, n, place, long = search(h, last, block)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + n, -1)
            for d, i in np.unique(np.stack([w.doc[at], block.item[place]]), axis=1).T.tolist():
                self.items.setdefault(d, set()).add(block.items[i])
            if locate:  # a match that goes on to the left is part of a longer one
                left = (at > w.first[w.doc[at]]) & (place > block.start[block.item[place]])
                inner = left & (h[np.maximum(at - 1, 0)] == block.words[np.maximum(place - 1, 0)])
                self.matches += [(d, block.items[i], a, p, m) for d, i, a, p, m in zip(w.doc[at][~inner].tolist(), block.item[place][~inner].tolist(), (at - w.first[w.doc[at]])[~inner].tolist(), (place - block.start[block.item[place]])[~inner].tolist(), long[~inner].tolist())]
        self.words = np.diff(w.first)
        hit = np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))
        self.hit = hit[w.first[1:]] - hit[w.first[:-1]]


def shared_blocks(docs: DataFrame, benchmark: DataFrame) -> list:
    spark = docs.sparkSession
    tune(spark)
    return [spark.sparkContext.broadcast(b) for b in blocks(benchmark, BLOCK_WORDS)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    shared = shared_blocks(docs, benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for i, j, part, cut in each_slice(*flat(b.column("text"))):
                f = Found(part, cut, shared, False)
                digest = [hashlib.sha256(",".join(sorted(f.items[k])).encode()).hexdigest() if k in f.items else nothing for k in range(j - i)]
                yield as_batch(schema, doc_id=ids.slice(i, j - i), n_words=f.words, n_hit=f.hit, n_items=[len(f.items.get(k, ())) for k in range(j - i)], items_sha256=digest, contaminated=f.hit > 0)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest verbatim matches of a window or more: doc_id, item_id (string), start and item_start (words), length (words)."""
    shared = shared_blocks(docs, benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, _, part, cut in each_slice(*flat(b.column("text"))):
                rows = Found(part, cut, shared, True).matches
                yield as_batch(schema, doc_id=[ids[i + r[0]] for r in rows], item_id=[r[1] for r in rows], start=[r[2] for r in rows], item_start=[r[3] for r in rows], length=[r[4] for r in rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id string, start long, item_start long, length long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns; no shuffle."""
    shared = shared_blocks(docs, benchmark)

    def run(batches):
        for b in batches:
            hits = [Found(part, cut, shared, False).hit for _, _, part, cut in each_slice(*flat(b.column(b.schema.get_field_index("text"))))]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, np.int64), *hits]) == 0))

    return docs.mapInArrow(run, docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


WORD_LIST = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORD_LIST} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS words FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM b),
s AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
m AS (SELECT doc_id, item_id, i, s.n FROM s JOIN t ON s.n = t.n AND s.words = t.words),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
