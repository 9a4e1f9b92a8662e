"""Encoders, votes over overlapping windows, and models on sequences."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import BOUNDARY, catalog_rows
from ..functions.labels import decode, decoded, encode
from ..session import stored
from .windows import in_chunks, row_numbers


def fit_ordinal(df: DataFrame, column: str, order: str = "line_idx") -> DataFrame:
    """value, code: codes in order of first appearance; null is a value."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return row_numbers(first, "first").select("value", F.col("i").alias("code"))


def encode_ordinal(df: DataFrame, column: str, mapping: DataFrame, order: str = "line_idx") -> DataFrame:
    """Adds code; values that the mapping doesn't have get new codes in order of first appearance."""
    values = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    fresh = values.join(mapping, values["value"].eqNullSafe(mapping["value"]), "left_anti")
    top = mapping.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("top"))
    added = row_numbers(fresh, "first").crossJoin(F.broadcast(top)).select("value", (F.col("top") + F.col("i") + 1).cast("long").alias("code"))  # top is one row
    every = mapping.unionByName(added)
    return df.join(every, df[column].eqNullSafe(every["value"]), "left").drop("value")


def decode_ordinal(df: DataFrame, mapping: DataFrame, code: str = "code") -> DataFrame:
    named = mapping.select(F.col("code").alias("_c"), F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("decoded"))
    return df.join(named, df[code] == named["_c"], "left").drop("_c").withColumn("decoded", F.coalesce("decoded", F.lit("UNKNOWN")))


def held_out(index: Column, share: float = 0.1, seed: int = 7) -> Column:
    """Whether a record is put aside for testing, by its number alone: the same wherever and however often it is asked. Plain arithmetic, so that any engine can say it."""
    x = F.pmod(F.pmod(index, F.lit(1 << 32)) * 2654435761 + F.lit(seed * 40503), F.lit(1 << 32))
    mixed = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * 73244475, F.lit(1 << 32))
    return F.shiftright(mixed, 12) < int(share * (1 << 20))


def weight(width: int, offset: Column) -> Column:
    """1 - |j - W/2| / (W/2), times W: an integer, so that ties are exact."""
    return width - F.abs(2 * offset - width)


def weight_of(width: int, offset: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    return width - np.abs(2 * offset - width)


def votes(predictions: DataFrame, width: int) -> DataFrame:
    """(k, label, weight, first): the weight that record k's votes give each label. predictions: (window_idx, offset, label)."""
    return predictions.withColumn("k", F.col("window_idx") + F.col("offset")).groupBy("k", "label").agg(F.sum(weight(width, F.col("offset"))).cast("long").alias("weight"), F.min("window_idx").alias("first"), F.count(F.lit(1)).alias("n"))


def weighted_vote(predictions: DataFrame, width: int) -> DataFrame:
    """k, predicted, n_votes; the first label that was voted for wins ties; records with fewer than W votes get BOUNDARY."""
    return resolve(votes(predictions, width), width).drop("n_labels")


def resolve(votes: DataFrame, width: int, key: tuple[str, ...] = ("k",)) -> DataFrame:
    """The key, predicted, n_votes and n_labels (different ones) of votes that are added up already."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "first", "label"))
    out = votes.groupBy(*key).agg(best.alias("b"), F.sum("n").cast("long").alias("n_votes"), F.count(F.lit(1)).alias("n_labels"))
    return out.select(*key, F.when(F.col("n_votes") < width, BOUNDARY).otherwise(F.col("b.label")).cast("int").alias("predicted"), "n_votes", "n_labels")


def vote_ranks(predictions: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """k, rank of the true label among the labels voted for (0: first); null if nobody voted for it."""
    w = Window.partitionBy("k").orderBy(F.desc("weight"), "first", "label")
    ranked = votes(predictions, width).withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return truth.join(ranked, (truth["line"] == ranked["k"]) & (truth["true_label"] == ranked["label"]), "left").select("line", F.col("place").alias("rank_"))


def majority(predictions: DataFrame) -> DataFrame:
    """k, predicted: the label with most votes, the smaller one of ties."""
    n = predictions.withColumn("k", F.col("window_idx") + F.col("offset")).groupBy("k", "label").count()
    return n.groupBy("k").agg(F.min(F.struct((-F.col("count")).alias("c"), "label")).alias("b")).select("k", F.col("b.label").alias("predicted"))


def vote_errors(predictions: DataFrame, truth: DataFrame, width: int, unscored: tuple[int, ...] = (-1, -2)) -> DataFrame:
    """Of each labelled record that all windows voted on: line, true_label, predicted, correct, bucket.

    truth: (line, true_label). bucket tells how a wrong one came about (`one, not in it`, `many, not in it`, `many, in it`: how
    many labels were voted for and whether the true one was); null where it is right or one of the labels can't be decoded.
    """
    told = weighted_vote(predictions, width).filter(F.col("predicted") != BOUNDARY)
    options = votes(predictions, width).groupBy("k").agg(F.collect_set("label").alias("labels"))  # at most `width` of them
    rows = truth.filter(F.col("true_label").isNotNull() & ~F.col("true_label").isin(*unscored)).join(told, truth["line"] == told["k"]).join(options, "k")
    right = F.col("true_label") == F.col("predicted")
    had = F.array_contains("labels", F.col("true_label"))
    bucket = F.when(right, None).when(F.size("labels") <= 1, "one, not in it").when(had, "many, in it").otherwise("many, not in it")
    out = rows.withColumns({"correct": right, "_b": bucket})
    known = decoded(out.select(F.col("true_label").alias("label")).unionByName(out.select(F.col("predicted").alias("label"))).distinct()).filter("NOT error").select("label")
    ok = out.join(known.withColumnRenamed("label", "_t"), F.col("true_label") == F.col("_t"), "left").join(known.withColumnRenamed("label", "_q"), F.col("predicted") == F.col("_q"), "left")
    return ok.select("line", "true_label", "predicted", "correct", F.when(F.col("_t").isNotNull() & F.col("_q").isNotNull(), F.col("_b")).alias("bucket"))


def indecisions(errors: DataFrame, predictions: DataFrame, width: int) -> DataFrame:
    """line, true_label, predicted, label, weight: all labels voted for, of the records that had the true one among several."""
    v = votes(predictions, width).select(F.col("k").alias("line"), F.col("label"), "weight")
    return errors.filter("bucket = 'many, in it'").select("line", "true_label", "predicted").join(v, "line")


#: The five parts of a label that the model predicts, each by a classifier of its own.
PARTS = ("type_id", "sub_id", "is_namespaced", "is_single", "verb_id")


def class_values() -> list[int]:
    """Type ids and 0, in order: a value's place is its class. All five parts share them."""
    return sorted({r[3] for r in catalog_rows()} | {0})


def class_of(value: Column) -> Column:
    """0 for what isn't among the values."""
    at = F.array_position(F.array(*map(F.lit, class_values())), value)
    return F.when(at > 0, at - 1).otherwise(0).cast("int")


def value_of(cls: Column) -> Column:
    return F.get(F.array(*map(F.lit, class_values())), cls.cast("int"))


def component_classes(spark) -> DataFrame:
    """value, class: the 59 classes as a table."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({v}, {k}L)" for k, v in enumerate(class_values())) + " AS c(value, class)")


def label_parts(label: Column) -> dict[str, Column]:
    """The five parts as numbers, 0 where the label says nothing."""
    return {k: F.coalesce(c.cast("int"), F.lit(0)) for k, c in decode(label).items()}


def fit_classifier(train: DataFrame, columns: list[str], label: str, kind: str = "forest", seed: int = 7, **settings):
    """The stand-in for the recurrent model: an ML pipeline over a record's and its neighbours' codes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = {"forest": lambda: RandomForestClassifier(labelCol=label, seed=seed, **{"numTrees": 10, "maxDepth": 6} | settings), "logistic": lambda: LogisticRegression(labelCol=label, **{"maxIter": 20} | settings), "tree": lambda: DecisionTreeClassifier(labelCol=label, seed=seed, **{"maxDepth": 5} | settings)}[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), made]).fit(train)


class Bundle:
    """What inference needs: encoders of the feature columns, the context columns and a classifier for each part of the label."""

    def __init__(self, columns: list[str], key: list[str], encoders: dict[str, DataFrame], models: dict):
        self.columns, self.key, self.encoders, self.models = columns, key, encoders, models

    def coded(self, records: DataFrame) -> tuple[DataFrame, list[str]]:
        """The records' columns as codes of the encoders, those of neighbours beside them; unseen values get a code beyond the known ones."""
        out = records
        for c, mapping in self.encoders.items():
            known = mapping.select(F.col("value").alias("_v"), F.col("code").alias(f"code_{c}"))
            out = out.join(known, out[c].eqNullSafe(known["_v"]), "left").drop("_v").fillna(mapping.count(), [f"code_{c}"])
        return context_columns(out, [f"code_{c}" for c in self.columns], self.key)

    def infer(self, records: DataFrame) -> DataFrame:
        """line_idx and predicted, the label that the parts make up."""
        out, _ = self.coded(records)
        for part, model in self.models.items():
            out = model.transform(out).withColumn(f"_{part}", value_of(F.col("prediction"))).drop("features", "rawPrediction", "probability", "prediction")
        made = encode(F.col("_type_id"), F.col("_sub_id"), F.col("_is_namespaced") == 1, F.col("_is_single") == 1, F.col("_verb_id"))
        return out.select("line_idx", made.alias("predicted"))

    def save(self, path: str) -> None:
        """Models, encoders and the feature list under one folder, which Spark reads and writes."""
        spark = next(iter(self.encoders.values())).sparkSession
        for part, model in self.models.items():
            model.write().overwrite().save(f"{path}/model-{part}")
        for c, mapping in self.encoders.items():
            mapping.write.mode("overwrite").parquet(f"{path}/encoder-{c}")
        spark.createDataFrame([(json.dumps({"columns": self.columns, "key": self.key, "parts": list(self.models)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @staticmethod
    def load(spark, path: str) -> Bundle:
        from pyspark.ml import PipelineModel

        told = json.loads(spark.read.text(f"{path}/features").first().value)
        return Bundle(told["columns"], told["key"], {c: spark.read.parquet(f"{path}/encoder-{c}") for c in told["columns"]}, {p: PipelineModel.load(f"{path}/model-{p}") for p in told["parts"]})


def train_bundle(records: DataFrame, columns: list[str], key: list[str], label: str = "label", kind: str = "tree", seed: int = 7) -> Bundle:
    """Encoders by first appearance and five classifiers, one for each part of the label. Wants line_idx, the columns, key and label."""
    bundle = Bundle(columns, key, {c: fit_ordinal(records, c) for c in columns}, {})
    rows, features = bundle.coded(records.filter(F.col(label).isNotNull()).withColumns({f"true_{k}": class_of(v) for k, v in label_parts(F.col(label)).items()}))
    rows = stored(records.sparkSession, rows.select(*features, *[f"true_{p}" for p in PARTS]), "features")  # a classifier goes over them several times
    bundle.models = {p: fit_classifier(rows, features, f"true_{p}", kind, seed) for p in PARTS}
    return bundle


def context_columns(df: DataFrame, columns: list[str], key: list[str], reach: int = 1, order: str = "line_idx") -> tuple[DataFrame, list[str]]:
    """Adds the columns' values of the rows before and after (-1 where there is none)."""
    rows, w, own = in_chunks(df, key, [order], behind=reach, ahead=reach)
    extra = {f"{c}_{d:+d}".replace("-", "m").replace("+", "p"): F.coalesce(F.lag(c, d).over(w) if d > 0 else F.lead(c, -d).over(w), F.lit(-1)) for c in columns for d in range(-reach, reach + 1) if d}
    return rows.withColumns(extra).filter(own).drop("_i", "_own", "_chunk"), [*columns, *extra]


def predict_hook(predict, columns: list[str], batch: int = 1024):
    """A column from an external model: predict takes and returns numpy arrays, a batch at a time."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    return predict_batch_udf(lambda: predict, return_type=T.DoubleType(), batch_size=batch)(*columns)
