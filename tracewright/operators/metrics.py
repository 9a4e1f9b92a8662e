"""Evaluation by counts: confusion, agreement, comparison of clusterings, summaries over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio(a, b):
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def counts(pairs: DataFrame) -> DataFrame:
    """(actual, predicted, n) of pairs; all other metrics start from this small table."""
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(n: DataFrame) -> DataFrame:
    """class, tp, actual_n, predicted_n, precision, recall, f1; undefined ones are null and out of any mean."""
    a = n.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("actual_n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = n.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    j = a.join(p, "class", "full").na.fill(0, ["actual_n", "predicted_n", "tp"])
    return j.withColumns({"precision": ratio(F.col("tp"), F.col("predicted_n")), "recall": ratio(F.col("tp"), F.col("actual_n"))}).withColumn("f1", ratio(2 * F.col("tp"), F.col("actual_n") + F.col("predicted_n")))


def core_metrics(pairs: DataFrame) -> DataFrame:
    c = per_class(counts(pairs))
    return c.agg(ratio(F.sum("tp"), F.sum("actual_n")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Row-normalised, without empty cells."""
    n = counts(pairs)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def true_class_metrics(pairs: DataFrame) -> DataFrame:
    """Of each true class, over its rows alone: accuracy, macro precision, recall and F1, and the number of rows.

    On rows of one true class a predicted class other than it has precision and F1 0 and no recall; so precision is
    shared out over the classes that were predicted, F1 over these and the true one, and recall is the accuracy.
    """
    by = counts(pairs).groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("weight"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"), F.count("predicted").alias("kinds"))
    accuracy, hit = ratio(F.col("tp"), F.col("weight")), (F.col("tp") > 0).cast("int")
    f1 = 2 * accuracy / (1 + accuracy) / (F.col("kinds") + 1 - hit)
    return by.select("class", accuracy.alias("accuracy"), ratio(hit, F.col("kinds")).alias("precision"), accuracy.alias("recall"), f1.alias("f1"), "weight")


def kappa(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cohen's kappa, of each key if given; 1 or 0 where chance agreement is 1."""
    key = key or []
    n = pairs.groupBy(*key, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    a = n.groupBy(*key, F.col("actual").alias("class")).agg(F.sum("n").alias("a"))
    p = n.groupBy(*key, F.col("predicted").alias("class")).agg(F.sum("n").alias("p"))
    chance = a.join(p, [*key, "class"]).groupBy(*key).agg(F.sum(F.col("a") * F.col("p")).alias("both"))
    joined = total.join(chance, key, "left") if key else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("total"), F.coalesce("both", F.lit(0)) / (F.col("total") * F.col("total"))
    return joined.select(*key, po.alias("p_o"), pe.alias("p_e"), F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def component_kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of each part of the labels, over pairs (actual, predicted) that can both be decoded."""
    from ..functions.labels import decoded
    from .sequence import PARTS, label_parts

    known = decoded(pairs.select(F.col("actual").alias("label")).unionByName(pairs.select(F.col("predicted").alias("label"))).distinct()).filter("NOT error")
    ok = known.select(F.col("label").alias("_l"))
    rows = pairs.join(ok, F.col("actual") == F.col("_l"), "left_semi").join(ok.withColumnRenamed("_l", "_m"), F.col("predicted") == F.col("_m"), "left_semi")
    a, p = label_parts(F.col("actual")), label_parts(F.col("predicted"))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("component"), a[k].alias("actual"), p[k].alias("predicted")) for k in PARTS])).alias("x")).select("x.*")
    return kappa(each, ["component"])


def metric_boxes(runs: DataFrame, names: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """metric, low, q1, median, q3, high of each metric over runs."""
    each = runs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*")
    return each.groupBy("metric").agg(F.min("v").alias("low"), *[F.percentile("v", q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.max("v").alias("high"))


def cluster_cells(truth: DataFrame, found: DataFrame) -> DataFrame:
    """gt, pred, shared, gt_size, pred_size, claims (true clusters that a found one shares lines with) and both sides' percentages. Both: (line_idx, cluster)."""
    j = truth.select("line_idx", F.col("cluster").alias("gt")).join(found.select("line_idx", F.col("cluster").alias("pred")), "line_idx", "left").withColumn("pred", F.coalesce("pred", F.lit("MISSING")))
    cells = j.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("shared"))
    sized = found.groupBy(F.col("cluster").alias("pred")).agg(F.count(F.lit(1)).alias("pred_size"))
    claims = cells.filter("pred <> 'MISSING'").groupBy("pred").agg(F.count(F.lit(1)).alias("claims"))
    whole = cells.groupBy("gt").agg(F.sum("shared").alias("gt_size"))
    out = cells.join(whole, "gt").join(sized, "pred", "left").join(claims, "pred", "left")
    return out.select("gt", "pred", "shared", "gt_size", "pred_size", "claims", F.round(100 * F.col("shared") / F.col("gt_size"), 2).alias("percent_gt"), F.round(100 * F.col("shared") / F.coalesce("pred_size", "shared"), 2).alias("percent_pred"))


def compare_clusterings(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Of each true cluster: gt, size, parts, category (perfect, merge, split or split_and_merge)."""
    by = cluster_cells(truth, found).groupBy("gt").agg(F.max("gt_size").alias("size"), F.count(F.lit(1)).alias("parts"), F.max((F.coalesce("claims", F.lit(0)) > 1).cast("int")).alias("shared"), F.max("pred_size").alias("_found"))
    whole = F.coalesce((F.col("parts") == 1) & (F.col("_found") == F.col("size")), F.lit(False))
    kind = F.when(F.col("parts") == 1, F.when((F.col("shared") == 0) & whole, "perfect").otherwise("merge")).when(F.col("shared") == 0, "split").otherwise("split_and_merge")
    return by.withColumn("category", kind).drop("_found")


BINS = [(2, "1"), (5, "(1,5)"), (10, "[5,10)"), (20, "[10,20)"), (50, "[20,50)")]


def size_bin(c):
    out = F.when(c <= 1, "1")
    for top, name in BINS[1:]:
        out = out.when(c < top, name)
    return out.otherwise(">=50")


def size_histogram(clusters: DataFrame) -> DataFrame:
    """Labels by the mean size of their clusters. clusters: (label, num_lines)."""
    mean = clusters.groupBy("label").agg(F.avg("num_lines").alias("mean"))
    return mean.groupBy(size_bin(F.col("mean")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # six rows


def weighted_accuracy(runs: DataFrame, most: int = 10, heavy: int = 3000, low: float = 0.96) -> DataFrame:
    """Classes over runs (class, accuracy, weight): weighted accuracy and mean weight of the first and last `most` by their product, and of the outliers.

    part: top, bottom or outlier (a weight beyond `heavy` or an accuracy below `low`).
    """
    by = runs.groupBy("class").agg(ratio(F.sum(F.col("accuracy") * F.col("weight")), F.sum("weight")).alias("accuracy"), F.avg("weight").alias("weight"))
    value = F.round(F.col("accuracy") * F.col("weight"), 6)
    parts = {"top": by.orderBy(value.desc(), "class").limit(most), "bottom": by.orderBy(value, F.desc("class")).limit(most), "outlier": by.filter((F.col("weight") > heavy) | (F.col("accuracy") < low))}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "class", "accuracy", "weight")
        out = rows if out is None else out.unionByName(rows)
    return out


def ablation(runs: DataFrame, metric: str = "precision", most: int = 5) -> DataFrame:
    """feature, value: what a run without just one feature reached, for the first and last `most`; the run with all features; the mean beyond the first.

    runs: run, features (array), and the metric of each attempt.
    """
    by = runs.groupBy("run", "features").agg(F.avg(metric).alias("value"))
    every = by.select(F.explode("features").alias("f")).agg(F.array_sort(F.collect_set("f")).alias("all"))  # as many as features
    missing = by.crossJoin(F.broadcast(every)).withColumn("missing", F.array_except("all", "features"))
    one = missing.filter(F.size("missing") == 1).select(F.regexp_replace(F.col("missing")[0], r"[\[\]]", "").alias("feature"), "value")
    best, last = one.orderBy(F.desc(F.round("value", 9)), "feature").limit(most), one.orderBy(F.round("value", 9), F.desc("feature")).limit(most)
    rest = one.join(best.select("feature"), "feature", "left_anti").agg(F.lit("Average").alias("feature"), F.avg("value").alias("value"))
    whole = missing.filter(F.size("missing") != 1).orderBy("run").limit(1).select(F.lit("All features").alias("feature"), "value")
    return best.unionByName(whole).unionByName(rest).unionByName(last.join(best.select("feature"), "feature", "left_anti"))


def kfold_runs(lines: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """run, attempts, trials, mean of each run of a log (line_idx, line) with so many trials; blank lines part runs."""
    from . import windows

    rows, _, own = windows.in_chunks(lines, [], ["line_idx"])
    told = windows.running(rows.withColumn("_blank", (F.trim("line") == "").cast("long")).filter(own), [], "_blank", "run")
    attempts = F.when(F.col("line").contains("STATISTICS_ATTEMPTS"), F.regexp_extract("line", ": *([0-9]+)", 1).cast("long"))
    accuracy = F.when(F.col("line").contains("Accuracy on labeled"), F.regexp_extract("line", r": *([0-9.]+)", 1).cast("double"))
    by = told.groupBy("run").agg(F.max(attempts).alias("attempts"), F.count(accuracy).alias("trials"), F.avg(accuracy).alias("mean"))
    return by.filter(F.col("trials").between(least, most))


def run_means(history: DataFrame) -> DataFrame:
    """Mean and deviation of each metric at each epoch over runs of different lengths. history: (run, metric, values array)."""
    flat = history.withColumn("metric", F.regexp_replace("metric", "_[0-9]+$", "")).select("metric", F.posexplode("values").alias("epoch", "value"))
    return flat.groupBy("metric", "epoch").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("runs"))
