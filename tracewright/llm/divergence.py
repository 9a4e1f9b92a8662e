"""Source divergence audit: how far each source's use of words lies from the others' of its language, and by which terms.

Counts. Executors count terms by (lang, source) and Arrow batch, exactly (terms are compared as strings); Spark adds them up. A language
keeps the terms that at least LEAST of its documents have; V is their number, N the occurrences of kept terms in a
group (a source of a language, or the whole language), and p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)).

Pairs, sparse and corrected from a baseline. If no source had any term, every term of a pair would give f(p0, q0), with p0 and q0
the probabilities of count 0: V times that is the baseline. A term that one of them has changes it by f(p, q0) - f(p0, q0), which depends
on its count alone: these are summed over each group's histogram of counts. Only terms that both have need both
counts: their corrections f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) are summed for each pair of groups within Arrow
batches of terms, each term's groups dealt to pairs of blocks of BLOCK groups. No row is made for a pair and a term.

Terms, by radix selection. Histograms of eight value bits at a time, from the upper ones down, give each group's k-th largest value; where more terms tie
at it than are needed, histograms of a byte at a time of their UTF-8 text, from where they first differ, find the last one
to be taken. Only what is chosen is sorted.

A null text, lang or source is ''. A row is a document, also if it repeats a doc_id or a text. A group without kept terms is a group still: its
pairs have the baseline alone, or 0 if its language keeps no term. A language of one source has no pairs. An empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, as_batch, each_slice, flat, load, stored, tune

LEAST, TOP, ONE = 10, 10, 1_000_000_000
#: Groups of a term that are compared with one another in one task, and pairs of which sums are held at a time.
BLOCK, MOST_PAIRS = 512, 1 << 18
#: Bytes of text of which terms are counted at a time.
SLICE = 4 << 20
#: Bytes that belong to terms: letters, and all of the characters beyond ASCII.
TERM = np.ones(256, bool)
TERM[:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False
#: Bits of a value (which is below 10**9 and a little), and how many of them a histogram tells apart: a group has 256 bins at most.
VALUE_BITS, DIGIT_BITS = 32, 8
GROUP = ["lang", "source"]


def terms_of(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of the texts, and the text that each is from."""
    low = LOWER[buf]
    inside = TERM[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    full = off[:-1] < off[1:]
    cut = off[:-1][full]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    sizes = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)  # between starts only the term's own bytes are inside
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(low[inside].tobytes())), np.searchsorted(off, start, "right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it)."""
    tune(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        for batch in batches:
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            for i, j, part, cut in each_slice(*flat(batch.column("text")), SLICE):
                found, doc = terms_of(part, cut)
                coded = found.dictionary_encode()
                key = group[i:j][doc] * len(coded.dictionary) + coded.indices.to_numpy()
                each, place, n = np.unique(key, return_inverse=True, return_counts=True)
                # Documents are in order: a term's place in a text counts once.
                seen = np.unique(doc.astype(np.int64) * max(1, len(each)) + place) % max(1, len(each))
                g, t = np.divmod(each, max(1, len(coded.dictionary)))
                a, b = np.divmod(g, max(1, len(source.dictionary)))
                yield as_batch(schema, lang=lang.dictionary.take(pa.array(a)), source=source.dictionary.take(pa.array(b)), term=coded.dictionary.take(pa.array(t)).cast(pa.string()), n=n, docs=np.bincount(seen, minlength=len(each)))

    found = docs.select(*GROUP, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, n: str = "size", v: str = "V") -> Column:
    """p of a count, exact; 0 if the language has no terms."""
    many = F.col(n).cast("decimal(20,0)") + 2 * F.col(v).cast("decimal(19,0)")
    return F.when(F.col(v) > 0, 1 + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 2), many)).otherwise(0).cast("long")


def apart(p: Column, q: Column) -> Column:
    """f of two probabilities."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_corrections(kept: DataFrame) -> DataFrame:
    """(a, b, value) for pairs of groups a < b: the corrections of the terms that both have, in parts. kept: lang, term, g, p, p0."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])
    sized = kept.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = kept.join(sized, ["lang", "term"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    item = F.struct("g", "p", "p0", "own")
    listed = dealt.groupBy("lang", "term", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def summed():
            a, b, value = (np.concatenate(x) for x in zip(*held))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            each, place = np.unique(at[: len(a)] * len(names) + at[len(a) :], return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, place, value)
            held[:] = [(names[each // len(names)], names[each % len(names)], total)]

        for batch in batches:
            items, cross = batch.column("items"), (pc.not_equal(batch.column("i"), batch.column("j"))).to_numpy(zero_copy_only=False)
            at = np.diff(items.offsets.to_numpy())
            begin = items.offsets.to_numpy()[:-1] - items.offsets[0].as_py()
            rows = items.flatten()
            g, p, p0, own = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for size in np.unique(at[at > 1]):
                for several in np.array_split(chosen := np.flatnonzero(at == size), max(1, len(chosen) * int(size) // MOST_PAIRS)):
                    head, over = begin[several], cross[several]
                    for k in range(1, int(size)):  # members k places apart, of all these terms together
                        x = (head[:, None] + np.arange(size - k)).ravel()
                        y = x + k
                        ok = ~np.repeat(over, size - k) | (own[x] != own[y])
                        x, y = x[ok], y[ok]
                        held.append((g[x], g[y], gaps(p[x], p[y]) - gaps(p[x], p0[y]) - gaps(p0[x], p[y]) + gaps(p0[x], p0[y])))
                        if sum(len(h[0]) for h in held) > 4 * MOST_PAIRS:
                            summed()
                            if len(held[0][0]) > MOST_PAIRS:
                                yield as_batch(schema, a=held[0][0], b=held[0][1], value=held[0][2])
                                held.clear()
        if held:
            summed()
            yield as_batch(schema, a=held[0][0], b=held[0][1], value=held[0][2])

    return listed.select("items", "i", "j").mapInArrow(run, "a long, b long, value long")


def pair_values(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(a, b, value) of all ordered pairs of groups of a language. groups: g, lang, p0, V; kept: lang, term, g, p, p0."""
    other = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").filter("g <> b").select(F.col("g").alias("a"), "b", (F.col("V") * apart(F.col("p0"), F.col("q0"))).alias("value"))
    histogram = kept.groupBy("lang", "g", "p", "p0").agg(F.count(F.lit(1)).alias("h"))
    one = histogram.join(other, "lang").filter("g <> b").select(F.col("g").alias("a"), "b", (F.col("h") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("value"))
    one = one.groupBy("a", "b").agg(F.sum("value").alias("value"))
    both = shared_corrections(kept)
    turned = [x.select(F.col("b").alias("a"), F.col("a").alias("b"), "value") for x in (one, both)]
    every = base.unionByName(one).unionByName(turned[0]).unionByName(both).unionByName(turned[1])
    return every.groupBy("a", "b").agg(F.sum("value").alias("value"))


def cut_bins(bins: DataFrame, descending: bool) -> DataFrame:
    """Of each group the bin in which its need-th row lies: g, bin, need (what of it is still needed), many (rows in it). bins: g, bin, many, need."""
    order = F.col("bin").desc() if descending else F.col("bin").asc()
    before = F.coalesce(F.sum("many").over(Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("before", before).filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("many") >= F.col("need"))).select("g", "bin", (F.col("need") - F.col("before")).alias("need"), "many")


def top_terms(rows: DataFrame, k: int = TOP) -> DataFrame:
    """Of each group the k terms of the largest value, of equal ones those that come first as UTF-8. rows: g, term, value, stored."""
    spark = rows.sparkSession
    told = None
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        upper = F.shiftright("value", shift)
        if told is None:
            bins = rows.groupBy("g", upper.alias("bin")).agg(F.count(F.lit(1)).alias("many")).withColumn("need", F.lit(k).cast("long"))
        else:
            within = rows.join(told.select("g", "least", "need"), "g").filter(F.shiftright("value", shift + DIGIT_BITS) == F.col("least"))
            bins = within.groupBy("g", "need", upper.alias("bin")).agg(F.count(F.lit(1)).alias("many"))
        told = stored(spark, cut_bins(bins, True).withColumnRenamed("bin", "least"), "thresholds")
    text = F.hex(F.encode("term", "UTF-8"))
    ties = stored(spark, rows.join(told.filter("many > need").select("g", "least", "need"), "g").filter("value = least").select("g", text.alias("text"), "need"), "ties")
    limits, going = [], ties
    while not going.isEmpty():
        # A byte more than what all have in common; a text that ends there comes first.
        span = going.groupBy("g").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.first("need").alias("need"))
        differ = F.filter(F.sequence(F.lit(1), F.length("a") + 1), lambda i: F.substr("a", i, F.lit(1)) != F.substr("b", i, F.lit(1)))
        width = 2 * F.floor((F.element_at(differ, 1) - 1) / 2) + 2
        reach = stored(spark, span.select("g", width.cast("int").alias("width")), "span")
        cut = F.substr("text", F.lit(1), F.col("width"))
        told_of = going.join(reach, "g").withColumn("bin", cut)
        bins = told_of.groupBy("g", "need", "bin").agg(F.count(F.lit(1)).alias("many"))
        state = stored(spark, cut_bins(bins, False), "limits")
        limits.append(state.filter("many = need").join(reach, "g").select("g", F.col("bin").alias("limit"), "width"))
        open_ = state.filter("many > need").select("g", F.col("bin").alias("open"), "need")
        going = stored(spark, going.drop("need").join(reach, "g").join(open_, "g").filter(cut == F.col("open")).select("g", "text", "need"), "ties")
    out = rows.join(told.select("g", "least"), "g", "left").filter("least IS NULL OR value >= least")
    if limits:
        every = limits[0]
        for more in limits[1:]:
            every = every.unionByName(more)
        out = out.join(every, "g", "left").filter((F.col("least").isNull()) | (F.col("value") > F.col("least")) | F.col("limit").isNull() | (F.substr(text, F.lit(1), F.col("width")) <= F.col("limit")))
    return out.select("g", "term", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    counts = stored(spark, term_counts(docs), "counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= least).drop("docs")
    rows = stored(spark, counts.select(*GROUP, "term", "n").join(totals, ["lang", "term"]), "kept")
    language = stored(spark, docs.select("lang").distinct().join(totals.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("total").alias("all")), "lang", "left").fillna(0, ["V", "all"]), "languages")
    held = docs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("documents")).join(rows.groupBy(*GROUP).agg(F.sum("n").alias("size")), GROUP, "left").fillna(0, ["size"])
    groups = stored(spark, held.join(language, "lang").withColumn("p0", probability(F.lit(0))).withColumn("g", F.monotonically_increasing_id()), "groups")
    named = rows.join(groups.drop("documents", "p0"), GROUP)
    kept = stored(spark, named.select("lang", "term", "g", probability(F.col("n")).alias("p"), probability(F.lit(0)).alias("p0"), probability(F.col("total"), "all").alias("q")), "terms")
    names = groups.select("g", *GROUP)
    pairs = pair_values(groups, kept.drop("q")).join(names.withColumnRenamed("g", "a"), "a").join(names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b").select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    telling = stored(spark, kept.filter("p > q").select("g", "term", apart(F.col("p"), F.col("q")).alias("value")), "telling")
    found = top_terms(telling, top).join(names, "g").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(found).withColumn("rank", F.row_number().over(order)).select(*GROUP, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS many FROM dense GROUP BY ALL),
p AS (SELECT dense.lang, dense.source, term, n, CAST(1 + CAST(1000000000 * (n + 2) AS HUGEINT) // CAST(many + 2 * v AS HUGEINT) AS BIGINT) AS p FROM dense JOIN sums USING (lang, source) JOIN v USING (lang)),
q AS (SELECT a.lang, term, CAST(1 + CAST(1000000000 * (n + 2) AS HUGEINT) // CAST(many + 2 * v AS HUGEINT) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL) a JOIN (SELECT lang, sum(many) AS many FROM sums GROUP BY lang) b ON a.lang = b.lang JOIN v ON v.lang = a.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
UNION ALL SELECT p.lang, source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
