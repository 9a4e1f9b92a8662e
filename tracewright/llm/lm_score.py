"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end a document. Their counts over all training documents are exact:
every chunk of documents sends its distinct words with their counts to hash buckets and is told the totals.
The model predicts a token's class from the two tokens before it: the most frequent words and the end are classes
of their own, all other words are dealt to SUFFIXES classes by their last three bytes. FREQUENT words and as many
more as the cube root of the vocabulary have a class (frequent()). Within a suffix class a word has its smoothed
share of the class's tokens, whatever the context, one place being left for unseen words, so token probabilities
are normalised over all words.

The class model is log-bilinear: the context's embeddings, each through a matrix of its place, predict an
embedding that is multiplied with those of all classes. It is trained in numpy by full passes over all distinct
class trigrams of the training documents, each weighted by its count, so that every training token has its share of
every pass; noise is drawn from the classes' frequencies. There are PASSES passes, more where they have fewer than
STEPS minibatches. The driver reads the trigrams in blocks from the shared folder; its steps grow with the distinct
trigrams. Log-probabilities are normalised by batched matrix products over the contexts that occur.

Learning leaves out the documents whose crc32(doc_id as text) mod 7 is 2. Null texts count as empty: one end.
A null doc_id is not held out. Rows that repeat a doc_id count on their own. With no training document at all
the counts are 0 and the classes' distribution is flat. Words are told apart by 64-bit hashes. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U, Words, as_batch, chunk_count, each_slice, flat, load, mix, stored, tune

FREQUENT, SUFFIXES, DIMENSIONS = 95, 64, 32
END, CLASSES = FREQUENT, FREQUENT + 1 + SUFFIXES
STEPS, BATCH, NOISE, RATE = 500, 4096, 64, 0.1
#: Least passes over the trigrams, and the least parts of a batch's weight that one trigram's pieces are cut to.
PASSES, SHARES = 2, 64
#: Distinct trigrams that a task counts before it hands them on, and that the driver trains on at a time.
HELD_TRIGRAMS, BLOCK_TRIGRAMS = 1 << 20, 1 << 20
#: Contexts normalised, and tokens scored, at a time.
CONTEXTS, SCORED = 2048, 1 << 16

SENT = "bucket int, chunk int, words binary, counts binary, kinds binary"
TOLD = "chunk int, bucket int, counts binary, top array<struct<word:long,n:long,kind:int>>, tokens array<long>, types array<long>"


def frequent(types: int) -> int:
    """Words that have a class of their own, for a vocabulary of so many words."""
    return FREQUENT + math.ceil(types ** (1 / 3))


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    return plain.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), chunk.alias("chunk"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix class of each word, and the first word of each document (and the number of words)."""
    w = Words(buf, off)
    kinds = (w.span_hash(np.maximum(w.start, w.end - 3), w.end) % U(SUFFIXES)).astype(np.uint8)
    return w.hashes(), kinds, w.first


def chunk_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of a chunk: hash and suffix class of each word, words of each document."""
    buf, off = flat(table.column("text"))
    parts = [words_of(b, o) for _, _, b, o in each_slice(buf, off)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.diff(p[2]) for p in parts])


def bounds_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted words fall into buckets by their upper half."""
    return np.searchsorted(((words >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))


def send_words(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        h, kinds, n = chunk_words(table)
        learn = ~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
        words, first, at = np.unique(h, return_index=True, return_inverse=True)
        counts = np.bincount(at, np.repeat(learn, n), len(words)).astype(np.uint32)
        bounds, kinds = bounds_of(words, buckets), kinds[first]
        full = np.flatnonzero(np.diff(bounds))
        cuts = [(bounds[b], bounds[b + 1]) for b in full]
        number = table.column("chunk")[0].as_py()
        return pa.Table.from_batches([as_batch(schema, bucket=full.astype(np.int32), chunk=[number] * len(full), **{n: [x[a:b].tobytes() for a, b in cuts] for n, x in (("words", words), ("counts", counts), ("kinds", kinds))})])

    return run


def sum_words(most: int):
    """Of a bucket: the total of each word that a chunk sent, and one row (chunk -1) of what the bucket has altogether, its `most` most frequent words with it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [np.frombuffer(r["words"], U) for r in rows]
        words, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]), len(words)).astype(np.int64)
        kinds = np.concatenate([np.frombuffer(r["kinds"], np.uint8) for r in rows])[first]
        ends = np.cumsum([len(s) for s in sent])
        back = [total[at[e - len(s) : e]].tobytes() for s, e in zip(sent, ends)]
        top = np.lexsort((words, -total))[:most]
        top = [{"word": int(words[k].view(np.int64)), "n": int(total[k]), "kind": int(kinds[k])} for k in top if total[k]]
        tokens, types = np.bincount(kinds, total, SUFFIXES).astype(np.int64), np.bincount(kinds, total > 0, SUFFIXES).astype(np.int64)
        schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("top", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("kind", pa.int32())]))), ("tokens", pa.list_(pa.int64())), ("types", pa.list_(pa.int64()))])
        none = [None] * len(rows)
        bucket = rows[0]["bucket"]
        return pa.Table.from_batches([as_batch(schema, chunk=[*(r["chunk"] for r in rows), -1], bucket=[bucket] * (len(rows) + 1), counts=[*back, None], top=[*none, top], tokens=[*none, tokens], types=[*none, types])])

    return run


class Classes:
    """Classes of words and the sums that smoothing needs: the frequent words, then the end, then SUFFIXES classes."""

    def __init__(self, top: list[tuple[int, int, int]], tokens: np.ndarray, types: np.ndarray, documents: int, end: int = END):
        self.end, self.size = end, end + 1 + SUFFIXES
        top = sorted((int(np.int64(w).view(U)), n, kind) for w, n, kind in top)
        self.words = np.array([w for w, _, _ in top], U)
        self.train_tokens, self.types = int(tokens.sum()) + documents, int(types.sum()) + (documents > 0)
        self.documents = documents
        tokens, types = tokens.copy(), types.copy()
        for _, n, kind in top:
            tokens[kind] -= n
            types[kind] -= 1
        self.room = np.log10(tokens + types + 1.0)  # of a suffix class: its tokens, its types' and an unseen word's one more

    def of(self, h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = kinds.astype(np.int64) + (self.end + 1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out[hit] = at[hit]
        return out


def trigrams(c: np.ndarray, n: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The number of (two tokens before, token) for each token of documents of n words, ends included; documents start after ends."""
    docs = len(n)
    last = np.cumsum(n + 1) - 1
    seq = np.full(int(n.sum()) + docs, end, np.int64)
    inner = np.ones(len(seq), bool)
    inner[last] = False
    seq[inner] = c
    one = np.concatenate([[end], seq[:-1]])
    two = np.concatenate([[end, end], seq[:-2]])[: len(seq)]
    second = last[:-1] + 2
    starts = np.concatenate([[0], last[:-1] + 1])
    two[starts] = end
    two[second[second < len(seq)]] = end
    classes = end + 1 + SUFFIXES
    return (two * classes + one) * classes + seq, last


def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their counts."""
    code, count = np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count[order], first) if len(code) else count


def trigram_counts(docs: DataFrame, classes: Classes, parts: int) -> DataFrame:
    """Stored rows (part, codes, counts): numbers and counts of the class trigrams of the training documents, dealt by hash."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    schema = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def rows(codes, counts):
        part = (mix(codes.view(U)) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        codes, counts = codes[order], counts[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        return as_batch(schema, part=full.astype(np.int32), codes=[codes[cuts[k] : cuts[k + 1]].tobytes() for k in full], counts=[counts[cuts[k] : cuts[k + 1]].tobytes() for k in full])

    def count(batches):
        codes, counts, kept = [], [], 0
        for b in batches:
            for _, _, part, cut in each_slice(*flat(b.column("text"))):
                h, kinds, first = words_of(part, cut)
                code, n = np.unique(trigrams(shared.value.of(h, kinds), np.diff(first), shared.value.end)[0], return_counts=True)
                codes.append(code)
                counts.append(n.astype(np.int64))
                kept += len(code)
                if kept > 2 * HELD_TRIGRAMS:
                    code, n = added(codes, counts)
                    codes, counts, kept = [code], [n], len(code)
                    if kept > HELD_TRIGRAMS:
                        yield rows(code, n)
                        codes, counts, kept = [], [], 0
        if codes:
            yield rows(*added(codes, counts))

    def add(table: pa.Table) -> pa.Table:
        codes, counts = added(*([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()] for c in ("codes", "counts")))
        return pa.Table.from_batches([as_batch(schema, part=[table.column("part")[0].as_py()], codes=[codes.tobytes()], counts=[counts.tobytes()])])

    learn = docs.filter(~held_out(F.col("doc_id").cast("long"))).select("text")
    shape = "part int, codes binary, counts binary"
    return stored(spark, learn.mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape), "trigrams")


def trigram_blocks(counted: DataFrame) -> Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]:
    """A way to read all numbers and counts, as often as wanted, in blocks of about BLOCK_TRIGRAMS; kept if they are one block."""
    kept: list = []

    def read():
        codes, counts, held, blocks = [], [], 0, 0
        for r in counted.orderBy("part").toLocalIterator():
            codes.append(np.frombuffer(r.codes, np.int64))
            counts.append(np.frombuffer(r.counts, np.int64))
            held += len(codes[-1])
            if held >= BLOCK_TRIGRAMS:
                yield np.concatenate(codes), np.concatenate(counts)
                codes, counts, held, blocks = [], [], 0, blocks + 1
        if codes:
            last = np.concatenate(codes), np.concatenate(counts)
            if not blocks:
                kept.append(last)
            yield last

    return lambda: kept or read()


def pieces(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every trigram with its count as weight; the heaviest in pieces, so that they are dealt over batches."""
    limit = max(1, math.ceil(counts.sum() / (SHARES * math.ceil(len(codes) / BATCH))))
    n = -(-counts // limit)
    return np.repeat(codes, n), np.repeat(counts / n, n)


class LogBilinear:
    def __init__(self, seed: int = 7, classes: int = CLASSES):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.context, self.target = (r.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.place = np.stack([np.eye(DIMENSIONS, dtype=np.float32)] * 2)
        self.bias = np.zeros(classes, np.float32)
        self.norms = np.zeros(0, np.float32)

    def train(self, codes: np.ndarray, counts: np.ndarray, seed: int = 11) -> LogBilinear:
        return self.train_blocks(lambda: [(codes, counts)] if len(codes) else [], seed)

    def train_blocks(self, blocks: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], seed: int = 11) -> LogBilinear:
        """Noise-contrastive estimation: a token is told from NOISE draws of the classes' frequencies; AdaGrad."""
        noise, weight, dealt, steps = np.ones(self.classes), 0.0, 0, 0
        for codes, counts in blocks():
            noise += np.bincount(codes % self.classes, counts, self.classes)
            n = len(pieces(codes, counts)[0])
            weight, dealt, steps = weight + counts.sum(), dealt + n, steps + math.ceil(n / BATCH)
        if not steps:
            return self
        r = np.random.default_rng(seed)
        noise /= noise.sum()
        level = np.log(NOISE * noise).astype(np.float32)
        self.bias = np.log(noise).astype(np.float32)
        seen = {n: np.full_like(getattr(self, n), 1e-6) for n in ("context", "target", "place", "bias")}
        passes, step = max(PASSES, math.ceil(STEPS / steps)), 0
        for _ in range(passes):
            for codes, counts in blocks():
                code, share = pieces(codes, counts)
                order = r.permutation(len(code))
                full = min(BATCH, len(code))
                for at in range(0, len(code), BATCH):
                    some = order[at : at + BATCH]
                    w = (share[some] * (dealt / weight / full)).astype(np.float32)[:, None]
                    self.step(code[some], w, r.choice(self.classes, NOISE, p=noise), level, seen, RATE * (1 - step / (passes * steps)) + 0.005)
                    step += 1
        return self

    def step(self, code: np.ndarray, w: np.ndarray, drawn: np.ndarray, level: np.ndarray, seen: dict[str, np.ndarray], rate: float) -> None:
        two, one, t = code // self.classes**2, code // self.classes % self.classes, code % self.classes
        a, b = self.context[two], self.context[one]
        q = a @ self.place[0] + b @ self.place[1]
        true = 1 / (1 + np.exp(-((q * self.target[t]).sum(1) + self.bias[t] - level[t])))
        false = 1 / (1 + np.exp(-(q @ self.target[drawn].T + self.bias[drawn] - level[drawn])))
        gt, gf = (true - 1)[:, None] * w, false * w
        gq = gt * self.target[t] + gf @ self.target[drawn]
        grad = {n: np.zeros_like(getattr(self, n)) for n in seen}
        np.add.at(grad["target"], t, gt * q)
        np.add.at(grad["target"], drawn, gf.T @ q)
        np.add.at(grad["bias"], t, gt[:, 0])
        np.add.at(grad["bias"], drawn, gf.sum(0))
        grad["place"][0], grad["place"][1] = a.T @ gq, b.T @ gq
        np.add.at(grad["context"], two, gq @ self.place[0].T)
        np.add.at(grad["context"], one, gq @ self.place[1].T)
        for n in seen:
            seen[n] += grad[n] ** 2
            getattr(self, n)[...] -= rate * grad[n] / np.sqrt(seen[n])

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the class's probability in its context; a context's norm is kept once it is known."""
        a, b = self.context @ self.place[0], self.context @ self.place[1]
        if not len(self.norms):
            self.norms = np.full(self.classes**2, np.nan, np.float32)
        met = np.zeros(self.classes**2, bool)
        met[codes // self.classes] = True
        new = np.flatnonzero(met & np.isnan(self.norms))
        for at in range(0, len(new), CONTEXTS):
            some = new[at : at + CONTEXTS]
            z = (a[some // self.classes] + b[some % self.classes]) @ self.target.T + self.bias
            top = z.max(1)
            self.norms[some] = top + np.log(np.exp(z - top[:, None]).sum(1))
        out = np.empty(len(codes))
        for at in range(0, len(codes), SCORED):
            some = codes[at : at + SCORED]
            context, t = some // self.classes, some % self.classes
            q = a[context // self.classes] + b[context % self.classes]
            out[at : at + SCORED] = np.einsum("ij,ij->i", q, self.target[t]) + self.bias[t] - self.norms[context]
        return out / np.log(10)

    def table(self) -> np.ndarray:
        """log10 of each class's probability in each context, flat, as trigrams() numbers them."""
        return self.scores(np.arange(self.classes**3)).astype(np.float32)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scorer(buckets: int, classes, model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        known, lm = classes.value, model.value
        h, kinds, n = chunk_words(table)
        words, at = np.unique(h, return_inverse=True)
        bounds, count = bounds_of(words, buckets), np.zeros(len(words), np.int64)
        for bucket, raw in zip(told.column("bucket").to_pylist(), told.column("counts").to_pylist()):
            count[bounds[bucket] : bounds[bucket + 1]] = np.frombuffer(raw, np.int64)
        c = known.of(h, kinds)
        codes, last = trigrams(c, n, known.end)
        inner = np.ones(len(codes), bool)
        inner[last] = False
        each = np.full(len(codes), known.documents, np.int64)
        each[inner] = count[at]
        base = np.log10(each + 1.0)
        score = lm.scores(codes)
        rare = np.flatnonzero(inner)[c > known.end]
        score[rare] += base[rare] - known.room[c[c > known.end] - known.end - 1]
        first = last - n
        size = n + 1
        room = np.log10(known.train_tokens + known.types + 1.0)
        return pa.Table.from_batches([as_batch(schema, doc_id=table.column("doc_id").combine_chunks(), held_out=table.column("held_out").combine_chunks(), n_tokens=size, n_known=np.add.reduceat((each > 0).astype(np.int64), first), train_tokens=np.full(len(n), known.train_tokens), base_score=np.add.reduceat(base, first) - size * room, score=np.add.reduceat(score, first))])

    return run


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    tune(spark)
    chunks = chunk_count(docs)
    rows = dealt(docs, chunks)
    told = stored(spark, rows.groupBy("chunk").applyInArrow(send_words(chunks), SENT).groupBy("bucket").applyInArrow(sum_words(frequent(chunks * CHUNK_BYTES)), TOLD), "words")
    summed = told.filter("chunk < 0")
    kinds = summed.select(F.posexplode(F.arrays_zip("tokens", "types"))).groupBy("pos").agg(F.sum("col.tokens").alias("tokens"), F.sum("col.types").alias("types")).collect()
    tokens, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in kinds:
        tokens[r.pos], types[r.pos] = r.tokens, r.types
    end = frequent(int(types.sum()))  # no more than each bucket has handed on, as words are fewer than bytes
    top = summed.select(F.explode("top").alias("t")).select("t.word", "t.n", "t.kind").orderBy(F.desc("n"), "word").limit(end).collect()
    documents = docs.filter(~held_out(F.col("doc_id").cast("long"))).count()
    classes = Classes([(r.word, r.n, r.kind) for r in top], tokens, types, documents, end)
    model = LogBilinear(classes=classes.size).train_blocks(trigram_blocks(trigram_counts(docs, classes, chunks)))
    run = scorer(chunks, spark.sparkContext.broadcast(classes), spark.sparkContext.broadcast(model))
    return rows.groupBy("chunk").cogroup(told.filter("chunk >= 0").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(run, OUT)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(load(spark, sf_dir, "documents"))
