"""Near duplicates: MinHash bands propose, odd sketches of the samples filter, whole shingle sets decide.

Documents with the same shingle set are one class with a number of its own and a smallest doc_id. SAMPLES MinHash values of a
class give BANDS keys of ROWS values each; at the threshold a pair of classes shares no key with a chance of
(1 - 0.75 ** ROWS) ** BANDS, 5 in a million. No pairs within a bucket are listed. Each bucket names a pivot,
the class that most other buckets know too, and its members are compared with that pivot alone, in rounds:

* Odd sketches (MinHash samples folded into parity bitmaps; the population count of their XOR estimates the
  similarity) drop members that are surely below FAR of the pivot; the others' whole sets decide.
* A member is kept as what it lacks of the pivot (a bitmap) and what it has besides. The members of a pivot
  that don't reach the threshold with it are then compared with its other members: the bitmaps' union bounds
  the intersection closely, and whole differences decide. Large groups are compared in blocks.
* The Jaccard distance is a metric: a class within NEAR of the pivot can be linked only to classes at FAR or
  more of that pivot, so it has met all its partners of that bucket and leaves it. Buckets with classes that
  the pivot was too far from go on to another round, with a pivot out of those.
* What is left after ROUNDS rounds is no large cluster any more: there the odd sketches of all classes of a
  bucket are compared in blocks, and only pairs that may reach the threshold come out.

Links, confirmed on full sets, are contracted to components by alternating stars.

Null and empty texts, and texts without words, have an empty set: linked with nothing. Rows with a null
doc_id are linked with nothing, have a null component_id and are kept. Rows that repeat a doc_id are judged each
by its own text; drop_near_duplicates() keeps all of them if one is kept. An empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, C3, U, Words, as_batch, each_slice, flat, load, mix, stored, tune, unused

WORDS, SHARE = 5, 75
BANDS, ROWS, BITS = 32, 4, 1024
#: Similarities, in percent, from which a class is compared with a pivot's others, and from which it has met all partners.
FAR, NEAR = 40, 65
#: Differing bits of two odd sketches beyond which a similarity of FAR is out of the question (five standard deviations).
MOST_BITS = 195
#: The same for the threshold itself.
MOST_LINKED = 125
ROUNDS = 3
#: Members of a pivot, or of a bucket, that are compared in one task.
BLOCK = 2048
SAMPLES = BANDS * ROWS
_random = np.random.default_rng(20240917)
_mul = _random.integers(0, 1 << 32, (2, SAMPLES), dtype=np.uint32) | np.uint32(1)


def shingles(w: Words) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its shingles."""
    h = w.hashes()
    rolled = mix(h + C3)
    for k in range(1, WORDS):
        rolled = mix(rolled[: len(rolled) - 1] * C1 + h[k:]) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:  # the whole sequence as one
            x = mix(h[a : a + 1] + U(b - a))
            for k in range(a + 1, b):
                x = mix(x * C1 + h[k : k + 1])
            out.append(x)
        else:
            out.append(h[:0])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES smallest values of each set, all of them non-empty."""
    h = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    low, high = h.astype(np.uint32), (h >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(low * _mul[0, k] + (high ^ (low >> np.uint32(7))) * _mul[1, k], at)
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: the parity, bit by bit, of the samples' hashes; BITS bits as 64-bit words."""
    bit = (mix(samples.astype(U) * C1 + np.arange(SAMPLES, dtype=U) * C3) >> U(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = np.zeros((len(samples), BITS), np.uint8)
    np.add.at(odd, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(odd & 1, axis=1).view(U)


def band_keys(samples: np.ndarray) -> np.ndarray:
    x = np.tile(np.arange(BANDS, dtype=U) * C3, (len(samples), 1))
    for k in range(ROWS):
        x = mix(x * C1 + samples[:, k::ROWS].astype(U))
    return x


SIGNED = "doc_id long, n_shingles long, a long, b long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, band keys and odd sketch of each row."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, part, cut in each_slice(*flat(batch.column("text"))):
                sets = shingles(Words(part, cut))
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                a, b = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                bands, sketch = [None] * (j - i), [None] * (j - i)
                if len(full):
                    h, at = np.concatenate(sets), np.cumsum(size[full]) - size[full]
                    a[full], b[full] = np.add.reduceat(mix(h + C1), at).view(np.int64), np.add.reduceat(mix(h * C3), at).view(np.int64)
                    samples = minhashes([sets[k] for k in full])
                    for k, x, y in zip(full, band_keys(samples).view(np.int64), sketches(samples).view(np.int64)):
                        bands[k], sketch[k] = x, y
                yield as_batch(schema, doc_id=ids.slice(i, j - i), n_shingles=size, a=a, b=b, bands=bands, sketch=sketch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v, s: the sorted shingle hashes of the classes in wanted (v, doc, a, b)."""
    schema = pa.schema([("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc")
            for i, j, part, cut in each_slice(*flat(batch.column("text"))):
                sets = shingles(Words(part, cut))
                yield as_batch(schema, doc=ids.slice(i, j - i), a=[int(mix(s + C1).sum(dtype=U).view(np.int64)) for s in sets], b=[int(mix(s * C3).sum(dtype=U).view(np.int64)) for s in sets], s=[s.tobytes() for s in sets])

    ids = wanted.select("doc").hint("shuffle_hash")  # texts go to identifiers, unsorted, at every size
    some = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(ids, "doc", "left_semi")
    return some.mapInArrow(run, "doc long, a long, b long, s binary").dropDuplicates(["doc", "a", "b"]).join(wanted, ["doc", "a", "b"]).select("v", "s")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (v, p) at FAR or more: sizes, shared, and v as what it lacks of p and what it has besides."""
    schema = pa.schema([("v", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("shared", pa.int64()), ("lacks", pa.binary()), ("besides", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for v, p, x, y in zip(batch.column("v").to_pylist(), batch.column("p").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.searchsorted(y, x)
                has = y[np.minimum(at, len(y) - 1)] == x
                shared = int(has.sum())
                if 100 * shared >= FAR * (len(x) + len(y) - shared):
                    lacks = np.ones(-(-len(y) // 64) * 64, np.uint8)
                    lacks[len(y) :] = 0
                    lacks[at[has]] = 0
                    out.append((v, p, len(x), len(y), shared, np.packbits(lacks).tobytes(), x[~has].tobytes()))
            yield as_batch(schema, **{n: [r[k] for r in out] for k, n in enumerate(schema.names)})

    rows = pairs.join(sets.select("v", F.col("s").alias("x")), "v").join(sets.select(F.col("v").alias("p"), F.col("s").alias("y")), "p")
    return rows.select("v", "p", "x", "y").mapInArrow(run, "v long, p long, n long, m long, shared long, lacks binary, besides binary")


def linked(shared, n, m):
    return 100 * shared >= SHARE * (n + m - shared)


def direct(near: DataFrame) -> DataFrame:
    return near.filter(linked(F.col("shared"), F.col("n"), F.col("m"))).select(F.col("v").alias("u"), F.col("p").alias("w"))


def among_members(near: DataFrame) -> DataFrame:
    """Links (u, w) between members of the same pivot, one of which at least isn't linked with the pivot itself."""
    schema = pa.schema([("u", pa.int64()), ("w", pa.int64())])
    counted = near.groupBy("p").agg(F.count(F.lit(1)).alias("many"), F.sum(F.when(linked(F.col("shared"), F.col("n"), F.col("m")), 0).otherwise(1)).alias("open")).filter("open > 0 AND many > 1")
    dealt = blocked(near.join(counted.drop("open"), "p"), "p", "many")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        v = np.array([r["v"] for r in rows])
        own = np.array([r["own"] for r in rows])
        n = np.array([r["n"] for r in rows])
        m = rows[0]["m"]
        main = np.array([linked(r["shared"], r["n"], m) for r in rows])
        lacks = np.stack([np.frombuffer(r["lacks"], U) for r in rows])
        besides = [np.frombuffer(r["besides"], U) for r in rows]
        values, times = np.unique(np.concatenate(besides), return_counts=True)
        again = values[times > 1]  # what one member alone has can't be shared
        besides = [x[np.isin(x, again)] for x in besides]
        more = np.array([len(x) for x in besides])
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        out = []
        for x in np.flatnonzero(~main):
            if 100 * (m - int(np.bitwise_count(lacks[x]).sum()) + more[x]) < SHARE * n[x]:
                continue  # too much of it is its own
            most = m - np.bitwise_count(lacks[x] | lacks).sum(1).astype(np.int64) + np.minimum(more, more[x])
            ok = linked(most, n[x], n) & (main | (v > v[x])) & (v != v[x])
            if cross:
                ok &= own != own[x]
            joined = False
            for y in np.flatnonzero(ok):
                if joined and main[y]:
                    continue  # the pivot links all of these already
                shared = m - int(np.bitwise_count(lacks[x] | lacks[y]).sum()) + len(np.intersect1d(besides[x], besides[y], assume_unique=True))
                if linked(shared, n[x], n[y]):
                    out.append((int(v[x]), int(v[y])))
                    joined |= bool(main[y])
        return pa.Table.from_batches([as_batch(schema, u=[o[0] for o in out], w=[o[1] for o in out])])

    return dealt.groupBy("p", "i", "j").applyInArrow(run, "u long, w long")


def blocked(df: DataFrame, key: str, many: str) -> DataFrame:
    """The rows of each key dealt to pairs (i, j) of blocks of at most about BLOCK rows; own: a row's block."""
    blocks = F.ceil(F.col(many) / BLOCK).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", many)


def close_sketches(left: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (v, p) of the classes left in a bucket, one of them far from its pivots, whose sketches allow a link."""
    schema = pa.schema([("v", pa.int64()), ("p", pa.int64())])
    sized = left.groupBy("key").agg(F.count(F.lit(1)).alias("many"))
    dealt = blocked(left.select("key", "v", "far").join(sketch, "v").join(sized, "key"), "key", "many")

    def run(table: pa.Table) -> pa.Table:
        v, far, own = (table.column(n).to_numpy() for n in ("v", "far", "own"))
        x = np.stack(table.column("sketch").to_pylist()).astype(np.int64).view(U)
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        out = []
        for k in np.flatnonzero(far):
            ok = np.bitwise_count(x[k] ^ x).sum(1, dtype=np.int64) <= MOST_LINKED
            ok &= (~far | (v < v[k])) & (v != v[k])
            if cross:
                ok &= own != own[k]
            out.append(np.stack([np.maximum(v[ok], v[k]), np.minimum(v[ok], v[k])]))
        pairs = np.concatenate([*out, np.zeros((2, 0), np.int64)], 1)
        return pa.Table.from_batches([as_batch(schema, v=pairs[0], p=pairs[1])])

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "v long, p long").distinct()


def components(links: DataFrame) -> DataFrame:
    """v, component (its smallest member) of every end of the links (u, w) but those members themselves; alternating large and small stars."""
    spark = links.sparkSession
    edges = stored(spark, links.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("least"))
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("u"), F.col("least").alias("w")).distinct()
        least = large.groupBy("u").agg(F.min("w").alias("least"))
        small = large.join(least, "u").filter("w <> least").select(F.greatest("w", "least").alias("u"), F.least("w", "least").alias("w")).unionByName(least.select("u", F.col("least").alias("w"))).distinct()
        edges = stored(spark, small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("v"), F.col("w").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    signed = stored(spark, signatures(docs), "signatures")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(spark, named.groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("v", F.monotonically_increasing_id()), "classes")
    members = classes.select("v", F.explode("bands").alias("key"))
    common = members.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high").select("key", "size")
    held = stored(spark, members.join(common, "key"), "buckets")
    known = held.groupBy("v").agg(F.sum("size").alias("known"))
    wanted = stored(spark, classes.select("v", "doc", "a", "b", "sketch").join(known, "v"), "wanted")
    sets = stored(spark, whole_sets(docs, wanted.select("v", "doc", "a", "b")), "sets")
    buckets = held.select("key", "v", F.lit(True).alias("far")).join(known, "v")
    sketch, found = wanted.select("v", "sketch"), []
    for _ in range(ROUNDS):
        pivots = buckets.groupBy("key").agg(F.min(F.when(F.col("far"), F.struct((-F.col("known")).alias("k"), F.col("v").alias("p")))).alias("pivot")).select("key", "pivot.p")
        round_ = stored(spark, buckets.join(pivots, "key"), "round")
        pairs = round_.filter("v <> p").select("v", "p").distinct().join(sketch, "v").join(sketch.select(F.col("v").alias("p"), F.col("sketch").alias("other")), "p")
        apart = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)
        near = stored(spark, compared(pairs.filter(apart <= MOST_BITS).select("v", "p"), sets), "near")
        found.append(direct(near))
        found.append(among_members(near))
        met = near.select("v", "p", (100 * F.col("shared") >= NEAR * (F.col("n") + F.col("m") - F.col("shared"))).alias("close"))
        left = round_.filter("v <> p").join(met, ["v", "p"], "left").filter("close IS NULL OR NOT close").select("key", "v", F.col("close").isNull().alias("far"), "known")
        going = left.groupBy("key").agg(F.max("far").alias("any"), F.count(F.lit(1)).alias("size")).filter("any AND size > 1").select("key")
        buckets = stored(spark, left.join(going, "key"), "left")
        if buckets.isEmpty():
            break
    found.append(direct(compared(close_sketches(buckets, sketch), sets)))
    links = reduce(DataFrame.unionByName, found)
    labels = components(links)
    labels = labels.unionByName(labels.select(F.col("component").alias("v"), "component").distinct())
    first = classes.select("v", "doc").join(labels, "v").groupBy("component").agg(F.min("doc").alias("least"))
    told = labels.join(first, "component").select("v", "least")
    named_classes = classes.select("a", "b", "v", "doc").join(told, "v", "left").select("a", "b", F.coalesce("least", "doc").alias("component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("a")).alias("a"), "b")
    out = rows.join(named_classes, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component (the one with the smallest doc_id) with all its columns, whatever these are called."""
    other = unused(docs, "gone_id")
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select(F.col("doc_id").alias(other))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(other), "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


#: Whole shingle sets, links by their common shingles, and the smallest identifier that links lead to.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1 : i + 5], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM s l JOIN s r USING (x) WHERE l.doc_id <> r.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
