"""Personal data: fixed finders for e-mail, IP, card and phone, then terms that give an entity away.

The second part follows information-theoretic sanitisation. An entity is the text of a base span. Over all
documents it is counted in how many documents a term occurs, in how many an entity does, and in how many the
term stands within REACH words of the entity, terms with digits too. The pointwise mutual information of term and entity, divided
by the entity's information content -log p(entity), says which share of the entity the term discloses: 1 if
the term never occurs without it. A pair seen in LEAST_TOGETHER documents or more that discloses REMOVE or
more is removed, one that discloses GENERALISE or more is replaced by its kind. Such terms add spans
`term:start:end` wherever they occur in any document; the base spans stay as they are. Texts are read three times: for
entities and the terms near them, for the document frequencies of those terms, and for the places of the terms that
disclose. A bit map of the terms' checksums, SPARE bits a term and MOST_BITS at most, says which words may be one, and a
join tells; with a map that is full the joins have more to do.

Null texts count as empty: no spans. A null doc_id is carried through; rows that repeat a doc_id keep a row
each and share the spans their texts have. Counts are of rows. Other columns play no part.
"""

import bisect
import collections
import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, load, stored, tune, unused

REACH, LEAST_TOGETHER, REMOVE, GENERALISE = 8, 3, 0.95, 0.85
KINDS = ("email", "ip", "card", "phone")
#: Distinct terms that a task counts before it hands them on, and words that a worker remembers.
HELD_TERMS, MOST_SEEN = 200_000, 1_000_000
#: Bits of the map of terms: for each term, altogether at most, and in a block that executors put together.
SPARE, MOST_BITS, BLOCK_BITS = 16, 1 << 27, 1 << 16

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken whole and a match begins where digits do: what a leftmost longest match does anyway, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}\"'*$%&#"


def emails(text: str):
    """Leftmost matches of local@domain, found from their @: a local part can't hold one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


DIGIT = re.compile("[^0-9]+")


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans by kind, then start; code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.sub("", m[0])) <= 15]
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def tokens(text: str, spans) -> list[tuple[int, int, bool]]:
    """(start, end, term) of all words in order, trimmed; spans part words, and words in spans or of less than 3 characters are no terms."""
    out = []

    def words(lo: int, hi: int, term: bool) -> None:
        for m in WORD.finditer(text, lo, hi):
            s = m.end() - len(m[0].lstrip(EDGE))
            e = s + len(m[0].strip(EDGE))
            out.append((s, e, term and e - s >= 3))

    at = 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a > at:
            words(at, a, True)
        if b > at:
            words(max(a, at), b, False)
            at = b
    words(at, len(text), True)
    return out


def blanked(text: str, spans) -> str:
    """The text with a space instead of each span."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return " ".join([*out, text[at:]])


class Terms:
    """The terms of texts that count, lower-cased. A worker remembers what it has met, word by word."""

    def __init__(self, counts: Callable[[str], bool]):
        self.counts = counts
        self.forget()

    def forget(self) -> None:
        self.seen: set[bytes] = set()
        self.hits: set[bytes] = set()
        self.term: dict[bytes, str] = {}

    def of(self, text: str, spans) -> set[str]:
        words = set(blanked(text, spans).encode().split())  # at ASCII white space
        if len(self.seen) > MOST_SEEN:
            self.forget()
        for raw in words - self.seen:
            word = raw.decode().strip(EDGE)
            if len(word) >= 3 and self.counts(term := word.lower()):
                self.hits.add(raw)
                self.term[raw] = term
        self.seen |= words
        return {self.term[raw] for raw in words & self.hits}


def context(text: str, spans) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms within REACH words of a base span and outside every span."""
    every = tokens(text, spans)
    starts, ends = [s for s, _, _ in every], [e for _, e, _ in every]
    out = set()
    for _, a, b in spans:
        before, after = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        for s, e, term in every[max(0, before - REACH - 1) : before] + every[after : after + REACH + 1]:
            if term:
                out.add((text[a:b], text[s:e].lower(), s, e))
    return sorted(out)


class Bits:
    """Which words may be among some terms: a bit for the checksum of each."""

    def __init__(self, terms: DataFrame):
        size = 1 << max(BLOCK_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (terms.count() * SPARE).bit_length()))
        block, shape = BLOCK_BITS // 8, pa.schema([("block", pa.int32()), ("bits", pa.binary())])

        def mark(batches):
            bits = np.zeros(size // 8, np.uint8)
            for b in batches:
                at = np.fromiter((zlib.crc32(x.as_py().encode()) & (size - 1) for x in b.column("term")), np.int64, b.num_rows)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            rows = bits.reshape(-1, block)
            full = np.flatnonzero(rows.any(1))
            yield as_batch(shape, block=full.astype(np.int32), bits=[rows[k].tobytes() for k in full])

        def unite(table: pa.Table) -> pa.Table:
            every = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
            return pa.Table.from_batches([as_batch(shape, block=[table.column("block")[0].as_py()], bits=[np.bitwise_or.reduce(every).tobytes()])])

        made = "block int, bits binary"
        bits = bytearray(size // 8)
        for r in terms.select("term").mapInArrow(mark, made).groupBy("block").applyInArrow(unite, made).toLocalIterator():
            bits[r.block * block : (r.block + 1) * block] = r.bits
        self.bits, self.mask, self.any = bytes(bits), size - 1, any(bits)
        self.terms: Terms | None = None

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "mask": self.mask, "any": self.any, "terms": None}

    def has(self, term: str) -> bool:
        at = zlib.crc32(term.encode()) & self.mask
        return self.bits[at >> 3] >> (at & 7) & 1 > 0

    def of(self, text: str, spans) -> set[str]:
        """The distinct words that may be among the terms."""
        self.terms = self.terms or Terms(self.has)
        return self.terms.of(text, spans) if self.any else set()

    def places(self, text: str, spans) -> list[tuple[str, int, int]]:
        """(term, start, end) of every word that may be among the terms."""
        some = self.of(text, spans)
        if not some:
            return []
        return [(x, s, e) for x, s, e in ((text[s:e].lower(), s, e) for s, e, term in tokens(text, spans) if term) if x in some]


FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<entity:string,term:string,start:long,stop:long>>"


def base_spans(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per document: counts, digest and text of the base spans, and near: the terms next to them or, given terms, all places that may hold one of these."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Bits(terms)) if terms is not None else None
    near = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("near", pa.list_(near))])

    def run(batches):
        for b in batches:
            cols: dict = {n: [] for n in schema.names[2:]}
            for t in b.column("text"):
                text = t.as_py() or ""
                spans = find(text)
                base = written(spans)
                for k, kind in enumerate(KINDS):
                    cols[f"n_{kind}"].append(sum(s[0] == k for s in spans))
                cols["base"].append(base)
                cols["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                found = [(None, *x) for x in shared.value.places(text, spans)] if shared else context(text, spans) if spans else []
                cols["near"].append([dict(zip(("entity", "term", "start", "stop"), x)) for x in found])
            yield as_batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), **cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, FOUND)


def document_frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df: in how many documents a term occurs, of all in wanted (term) and maybe others; the same tokens as context() has.

    A task adds up what it has read and hands it on whenever it holds HELD_TERMS terms.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Bits(wanted))
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])

    def run(batches):
        held: collections.Counter = collections.Counter()
        for b in batches:
            for x in b.column("text"):
                text = x.as_py() or ""
                held.update(shared.value.of(text, find(text)))
                if len(held) >= HELD_TERMS:
                    yield as_batch(schema, term=list(held), df=list(held.values()))
                    held.clear()
        if held:
            yield as_batch(schema, term=list(held), df=list(held.values()))

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, disclosure: the pairs whose disclosure reaches GENERALISE. found has row, one a document, and near."""
    total = docs.count()

    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term").distinct()
    pairs = stored(docs.sparkSession, near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= LEAST_TOGETHER), "pairs")
    entities = near.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(entities, "entity").join(document_frequencies(docs, pairs.select("term").distinct()), "term", "left")
    seen = F.when(F.col("df") >= F.col("together"), F.col("df")).otherwise(F.raise_error(F.concat(F.lit("document frequency missing or too small: "), "term")).cast("long"))
    mutual = F.log(F.col("together") * float(max(total, 1)) / (seen * F.col("n")))
    content = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    return counted.select("entity", "term", F.when(content > 0, mutual / content).otherwise(0.0).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_base (their sum), base_sha256, spans, n_terms, terms.

    terms: array of (start, stop, disclosure) of the added spans.
    """
    spark = docs.sparkSession  # every base span has a digit or an @
    beside = stored(spark, base_spans(docs.filter(F.col("text").rlike("[@0-9]"))).filter(F.size("near") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", "near"), "near")
    told = stored(spark, disclosures(docs, beside).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")
    found = stored(spark, base_spans(docs, told).withColumn("row", F.monotonically_increasing_id()), "spans")
    places = found.filter(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.term", "x.start", "x.stop")
    added = places.join(told, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "disclosure"))).alias("terms"))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["stop"].cast("string"))))
    out = found.drop("near").join(added, "row", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:bigint,stop:bigint,disclosure:double>>)")))
    of_kind = [f"n_{k}" for k in KINDS]
    return out.select("doc_id", *of_kind, F.expr(" + ".join(of_kind)).alias("n_base"), "base_sha256", spans.alias("spans"), F.size("terms").cast("long").alias("n_terms"), "terms", "row", "base", "text_hash")


def cleaned(text: str, spans: str, terms) -> str:
    """The text with base spans replaced by their kind, and terms removed or replaced by `[term]`."""
    cuts = [(int(a), int(b), f"[{k}]") for k, a, b in (s.split(":") for s in spans.split(",") if s) if k != "term"]
    cuts += [(s, e, "" if d >= REMOVE else "[term]") for s, e, d in terms]
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a < at:  # inside what another finder has replaced already
            at = max(at, b)
            continue
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, whatever these are called, their texts sanitised; as many rows as before.

    Spans go to rows by doc_id and a hash of the text: rows that agree in both have the same spans.
    """
    tune(docs.sparkSession)
    key, spans, terms = (unused(docs, n) for n in ("span_key", "found_spans", "found_terms"))

    def named(doc_id, text_hash):
        return F.concat_ws(":", text_hash, doc_id.cast("long"))

    got = personal_data(docs).select(named(F.col("doc_id"), F.col("text_hash")).alias(key), F.col("spans").alias(spans), F.col("terms").alias(terms))
    joined = docs.withColumn(key, named(F.col("doc_id"), F.xxhash64("text"))).join(got.dropDuplicates([key]), key, "left").drop(key)
    columns, at = docs.columns, [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            told = zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist())
            clean = pa.array([t and cleaned(t, s or "", [(x["start"], x["stop"], x["disclosure"]) for x in ts or []]) for t, s, ts in told], pa.string())
            yield b.select(range(len(columns))).set_column(at, b.schema.field(at).with_type(pa.string()), clean)

    return joined.select(*columns, spans, terms).mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(load(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS), "n_base", "base_sha256", "spans", "n_terms")
