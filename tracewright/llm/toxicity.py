"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of hashed features of its words (whole words and the first four,
five and six bytes, so that inflected forms share evidence); a document's score is the noisy-or of its
sentences' scores: one minus the product of what each sentence leaves. Only documents carry labels; the
gradient of the noisy-or shares a document's label among its sentences, and the trained sentence scores then
tell which sentences offend.

Training takes the labelled rows outside the held-out third, at most MOST_TOXIC toxic and MOST_CLEAN other
ones (those with the smallest hash of their doc_id); everything else covers all rows. The features that
enter the model are those whose presence in a document speaks for label 1. Executors read the sample's texts,
count the features and turn each document into the sentences that hold a feature of the model, as numbers of
features, and the number of those that hold none. Texts never reach the driver, which gets these bags alone.

Null texts count as empty; an empty text has no sentence and scores 0. A null doc_id is not held out and is
never trained on. Null labels are no labels; a doc_id with two labels counts as toxic if one says so, one with
several texts is learnt by the smallest of them. With no labelled row of one kind the model is the constant 0.
Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, SPACE, U, Words, as_batch, each_slice, flat, load, stored, tune

MOST_TOXIC, MOST_CLEAN = 2000, 4000
BIAS, ROUNDS, RATE, DECAY = -6.0, 120, 0.7, 1e-5
#: Features enter the model from this likelihood-ratio statistic on (one chance in 16,000 for noise).
LEAST_EVIDENCE = 16
#: and if they are so many times as frequent in toxic documents as in others: a sentence offends by what it has.
LEAST_RATIO = 10
THRESHOLD = 0.7
#: Sentences end at . ! ? ; and at line ends. Words are runs of letters: everything else in ASCII separates them.
STOP = np.zeros(256, bool)
STOP[[*b".!?;\n"]] = True
APART = SPACE.copy()
APART[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LEADS = (4, 5, 6)


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (words x kinds, hashed), the first word of each sentence, the sentences' documents, starts and ends."""
    w = Words(buf, off, APART)
    if not len(w.start):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(LEADS)), np.uint32), none, none, none, none
    size = w.end - w.start
    kinds = [w.hashes()] + [w.span_hash(w.start, np.minimum(w.end, w.start + k)) * C1 + U(k) for k in LEADS]
    x = np.stack([(h >> U(32)).astype(np.uint32) for h in kinds], 1)
    for k, lead in enumerate(LEADS):
        x[size < lead, k + 1] = x[size < lead, 0]  # a short word is itself
    stops = np.cumsum(STOP[buf])
    group = stops[w.start]
    new = np.ones(len(w.start), bool)
    new[1:] = (group[1:] != group[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w.start)) - 1
    return x, first, w.doc[first], w.start[first], w.end[last]


class Model:
    """Sorted hashes of the features that count, their weights, the bias of a sentence."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[features & 0xFFFF] = True

    def found(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the model's features that they hold."""
        row, kind = np.nonzero(self.maybe[x & 0xFFFF])
        if not len(self.features) or not len(row):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.features, x[row, kind]), len(self.features) - 1)
        ok = self.features[at] == x[row, kind]
        return row[ok], at[ok]

    def sentence_scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        row, at = self.found(x)
        z = np.bincount(np.searchsorted(first, row, "right") - 1, self.weights[at], len(first)) if len(row) else np.zeros(len(first))
        return logistic(z + self.bias)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


NEVER = Model(np.zeros(0, np.uint32), np.zeros(0), -30.0)


def noisy_or(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), docs))


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, df, both: in how many documents of the sample (y, text) a feature occurs, and in how many of label 1."""
    schema = pa.schema([("feature", pa.int64()), ("df", pa.int64()), ("both", pa.int64())])

    def run(batches):
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, part, cut in each_slice(*flat(b.column("text"))):
                x, first, doc, _, _ = sentences(part, cut)
                if not len(x):
                    continue
                of = doc[np.searchsorted(first, np.arange(len(x)), "right") - 1].astype(U)
                key = np.unique((of[:, None] << U(32) | x).ravel())
                feature, at = np.unique(key & U(0xFFFFFFFF), return_inverse=True)
                both = np.bincount(at, y[i + (key >> U(32)).astype(np.int64)], len(feature))
                yield as_batch(schema, feature=feature.view(np.int64), df=np.bincount(at, minlength=len(feature)), both=both.astype(np.int64))

    return sample.select("y", "text").mapInArrow(run, "feature long, df long, both long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("both").alias("both"))


def telling(counts: DataFrame, n: int, toxic: int) -> DataFrame:
    """The features whose presence in a document speaks for label 1 strongly enough, by a likelihood-ratio test."""

    def part(k, rows, label):
        return F.when(k > 0, k * F.log(k * float(n) / (rows * label))).otherwise(0.0)

    df, both, clean = F.col("df"), F.col("both"), n - toxic
    ratio = 2 * (part(both, df, toxic) + part(df - both, df, clean) + part(toxic - both, n - df, toxic) + part(clean - df + both, n - df, clean))
    return counts.filter((ratio >= LEAST_EVIDENCE) & (both * clean > LEAST_RATIO * (df - both) * toxic)).select("feature")


def bags(sample: DataFrame, shape: Model) -> DataFrame:
    """id, y, plain (sentences that hold no feature of the model), sizes (features in each other sentence), features (their numbers)."""
    shared = sample.sparkSession.sparkContext.broadcast(shape)
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("plain", pa.int64()), ("sizes", pa.binary()), ("features", pa.binary())])

    def run(batches):
        for b in batches:
            ids, y = b.column("id"), b.column("y")
            for i, j, part, cut in each_slice(*flat(b.column("text"))):
                x, first, doc, _, _ = sentences(part, cut)
                row, at = shared.value.found(x)
                sentence = np.searchsorted(first, row, "right") - 1 if len(row) else row
                some, sizes = np.unique(sentence, return_counts=True)
                holds = np.searchsorted(doc[some], np.arange(j - i + 1))
                ends = np.append(0, np.cumsum(sizes))[holds]
                plain = np.bincount(doc, minlength=j - i) - np.diff(holds)
                cut_up = lambda v, c: [v[a:e].astype(np.uint32).tobytes() for a, e in zip(c[:-1], c[1:])]
                yield as_batch(schema, id=ids.slice(i, j - i), y=y.slice(i, j - i), plain=plain, sizes=cut_up(sizes, holds), features=cut_up(at, ends))

    return sample.select("id", "y", "text").mapInArrow(run, "id long, y int, plain long, sizes binary, features binary")


def fit(shape: Model, y: np.ndarray, plain: np.ndarray, doc: np.ndarray, row: np.ndarray, col: np.ndarray) -> Model:
    """Sentence weights and bias that make the noisy-or fit the documents' labels; AdaGrad on the whole sample.

    doc: of each sentence with features; row, col: sentences and features that meet; plain: other sentences of each document.
    """
    n, w, bias = len(doc), np.zeros(len(shape.features)), BIAS
    seen, used = np.full(len(w), 1e-6), 1e-6
    for _ in range(ROUNDS):
        p, p0 = logistic(np.bincount(row, w[col], n) + bias), logistic(np.array(bias))
        left = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-p0)
        bag = np.clip(-np.expm1(left), 1e-6, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - bag) / bag, 1.0)
        g = pull[doc] * p
        grad = np.bincount(col, g[row], len(w)) / len(y) + DECAY * w
        seen += grad * grad
        w -= RATE * grad / np.sqrt(seen)
        gb = (g.sum() + (pull * plain).sum() * p0) / len(y)
        used += gb * gb
        bias -= 0.1 * RATE * gb / np.sqrt(used)
    return Model(shape.features, w, float(bias))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample: its ids are chosen from the labels alone, then their texts are read where they lie."""
    spark = documents.sparkSession
    tune(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = known.filter(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    ids = usable.filter("toxic = 1").orderBy("turn", "doc_id").limit(MOST_TOXIC).unionByName(usable.filter("toxic <> 1").orderBy("turn", "doc_id").limit(MOST_CLEAN))
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).cast("int").alias("y")))  # at most MOST_TOXIC + MOST_CLEAN rows
    rows = documents.join(chosen, F.col("doc_id").cast("long") == F.col("id")).groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = stored(spark, rows, "sample")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return NEVER
    features = np.sort(telling(feature_counts(sample), n, toxic).toArrow().column("feature").to_numpy()).astype(np.uint32)
    shape = Model(features, np.zeros(len(features)), BIAS)
    got = bags(sample, shape).toArrow().sort_by("id")  # no text: numbers of the model's features alone
    numbers = lambda c: [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column(c)]
    sizes, cols = numbers("sizes"), numbers("features")
    doc = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
    row = np.repeat(np.arange(len(doc)), np.concatenate(sizes))
    return fit(shape, got.column("y").to_numpy(), got.column("plain").to_numpy(), doc, row, np.concatenate(cols).astype(np.int64))


def worst_sentences(buf, off, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: its score, and where its worst sentence starts and ends (bytes) and what that scores; -1, -1, 0 without a sentence."""
    n = len(off) - 1
    score, worst, at, to = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1)
    for i, j, a, cut in each_slice(buf, off):
        x, first, doc, start, end = sentences(a, cut)
        p = model.sentence_scores(x, first)
        score[i:j] = np.clip(noisy_or(p, doc, j - i), 0, 1)
        order = np.lexsort((np.arange(len(p)), -p, doc))
        top = order[np.append(True, doc[order][1:] != doc[order][:-1])[: len(order)]]
        here = i + doc[top]
        worst[here], at[here], to[here] = p[top], start[top] - cut[doc[top]], end[top] - cut[doc[top]]
    return score, worst, at, to


def scored(buf, off, model: Model) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    for i, j, a, cut in each_slice(buf, off):
        x, first, doc, _, _ = sentences(a, cut)
        out[i:j] = noisy_or(model.sentence_scores(x, first), doc, j - i)
    return np.clip(out, 0, 1)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and worst_score, worst_start, worst_end (bytes) of its worst sentence."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_score", pa.float64()), ("worst_start", pa.int64()), ("worst_end", pa.int64())])

    def run(batches):
        for b in batches:
            score, worst, at, to = worst_sentences(*flat(b.column("text")), shared.value)
            yield as_batch(schema, doc_id=b.column("doc_id"), score=score, worst_score=worst, worst_start=at, worst_end=to)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_score double, worst_start long, worst_end long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (text) and score of each sentence that scores at least that much."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids, (buf, off) = b.column("doc_id").to_pylist(), flat(b.column("text"))
            for i, _, a, cut in each_slice(buf, off):
                x, first, doc, start, end = sentences(a, cut)
                p = shared.value.sentence_scores(x, first)
                at = np.flatnonzero(p >= least)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i + doc[k]] for k in at], pa.int64()), "sentence": pa.array([a[start[k] : end[k]].tobytes().decode(errors="replace") for k in at], pa.string()), "score": pa.array(p[at])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence string, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the threshold, with all their columns; no shuffle."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scored(*flat(b.column(b.schema.get_field_index("text"))), shared.value) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return scores(documents, train(documents, load(spark, sf_dir, "labels")))
