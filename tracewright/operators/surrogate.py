"""A decision tree that stands for a window model: fitted again and again to where it fails, chosen by agreement, cut to its largest branches.

Windows are flattened to a column for each feature and place, named f_t0, f_t1, ... The model's class at a window's first
place is what the tree has to tell. An inner round fits a tree to the windows in use, each weighed by how often it is in use, measures it on those
put aside, and takes in the windows of a fresh sample that it gets wrong. The best tree of a few inner rounds enters the outer round; of the outer
rounds' trees the one that agrees most with the others is the explanation.

All outer rounds go on in the same passes over windows that are packed into columns of small numbers: a pass counts (node, value, class) for the nodes of
a depth, the driver chooses where they are split, and one more pass measures the trees and weighs the windows anew. The driver holds trees of a bounded depth.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch, ship, stored
from . import metrics, network, recurrent

#: Shares, in thousandths, of windows that measure the explanation, and of those in use that measure a tree of an inner round.
TEST, ASIDE = 100, 300
#: Windows packed into a row; counts that a pass holds.
PACK, CELLS = 1 << 14, 1 << 22
COLUMNS = ["window", "mimic", "x", "weight"]
PACKED = ", ".join(f"{c} binary" for c in COLUMNS)


def flat_windows(data: recurrent.Blocks, run: recurrent.Run, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """window, mimic and truth (classes of the first part at the first place, truth -1 if unknown) and a column for each feature and place."""
    width, features, parts = run.shape.width, data.features, data.parts
    slim, = recurrent.light([run], best=True)
    names = [f"{c}_t{t}" for t in range(width) for c in columns]

    def flatten(batches):
        for _, first, _, codes, targets in recurrent.rows_of(batches, features, parts):
            starts = recurrent.starts_of(first, len(codes), width)
            if len(starts):
                told = network.predict(slim.shape, slim.weights, codes, starts)[:, 0, 0]
                x = codes[starts[:, None] + np.arange(width)].reshape(len(starts), -1)
                yield pa.RecordBatch.from_pydict({"window": first + starts, "mimic": pa.array(told, pa.int32()), "truth": pa.array(targets[starts, 0], pa.int32()), **{n: pa.array(x[:, k], pa.int32()) for k, n in enumerate(names)}})

    return data.table.select(*recurrent.READ).mapInArrow(flatten, "window long, mimic int, truth int, " + ", ".join(f"`{n}` int" for n in names)), names


@dataclass
class Leaf:
    """What leads to a leaf: (column, True for `at most`, value) each; and the class there."""

    path: tuple[tuple[str, bool, float], ...]
    told: int
    rows: int = 0
    right: int = 0

    def holds(self) -> Column:
        out = F.lit(True)
        for name, most, value in self.path:
            out = out & ((F.col(f"`{name}`") <= value) if most else (F.col(f"`{name}`") > value))
        return out

    def text(self) -> str:
        return " and ".join(f"{name} {'<=' if most else '>'} {value:g}" for name, most, value in self.path) or "always"


@dataclass
class Tree:
    """A tree on its way: node k's children are 2k + 1 (values up to the cut) and 2k + 2. feature: -1 at leaves; cut: a place in a column's values; told: a node's class; rows: what it was fitted to."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    told: np.ndarray = field(init=False)
    rows: int = 0

    def __post_init__(self):
        self.feature, self.cut, self.told = np.full((1 << self.depth + 1) - 1, -1), *np.zeros((2, (1 << self.depth + 1) - 1), np.int64)

    def nodes(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The node that each of the windows (places of x's rows, all if none are given) has come to."""
        at = np.arange(x.shape[1]) if at is None else at
        out = np.zeros(len(at), np.int64)
        for _ in range(self.depth):
            feature = self.feature[out]
            if (feature < 0).all():
                break
            out = np.where(feature < 0, out, 2 * out + 1 + (x[feature, at] > self.cut[out]))
        return out

    def split(self, node: int, counts: np.ndarray, offsets: np.ndarray, widths: np.ndarray) -> list[int]:
        """Takes in a node's counts (value of each column, class) and splits it by the least Gini impurity, of equal splits by the first; the children that may be split again."""
        total = counts[offsets[0] : offsets[0] + widths[0]].sum(0)
        n = total.sum()
        if not node:
            self.rows, self.told[0] = int(n), total.argmax()
        if 2 * node + 2 >= len(self.feature) or total.max() == n:
            return []
        left = np.concatenate([counts[o : o + w].cumsum(0) for o, w in zip(offsets, widths)])
        left, right = left.astype(np.float64), (total - left).astype(np.float64)
        on, off = left.sum(1), right.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            pure = np.where((on > 0) & (off > 0), (left * left).sum(1) / on + (right * right).sum(1) / off, 0.0)
        best = int(pure.argmax())
        if pure[best] <= (total.astype(np.float64) ** 2).sum() / n * (1 + 1e-12):
            return []
        self.feature[node] = np.searchsorted(offsets, best, side="right") - 1
        self.cut[node] = best - offsets[self.feature[node]]
        both = {2 * node + 1: left[best], 2 * node + 2: right[best]}
        for child, of in both.items():
            self.told[child] = of.argmax()
        return [child for child, of in both.items() if of.max() < of.sum() and 2 * child + 2 < len(self.feature)]

    def merged(self) -> None:
        """Children that are leaves of one class become one leaf."""
        for node in reversed(range(len(self.feature) // 2)):
            pair = [2 * node + 1, 2 * node + 2]
            if self.feature[node] >= 0 and (self.feature[pair] < 0).all() and self.told[pair[0]] == self.told[pair[1]]:
                self.feature[node], self.told[node] = -1, self.told[pair[0]]

    def leaves(self, names: list[str], values: list[np.ndarray], classes: np.ndarray, node: int = 0, path: tuple = ()) -> list[Leaf]:
        k = int(self.feature[node])
        if k < 0:
            return [Leaf(path, int(classes[self.told[node]]))]
        middle = float(values[k][self.cut[node]] + values[k][self.cut[node] + 1]) / 2
        return [leaf for most in (True, False) for leaf in self.leaves(names, values, classes, 2 * node + 2 - most, (*path, (names[k], most, middle)))]


def told_by(leaves: list[Leaf], otherwise: int | None = None) -> Column:
    out = F.when(leaves[0].holds(), leaves[0].told)
    for leaf in leaves[1:]:
        out = out.when(leaf.holds(), leaf.told)
    return out if otherwise is None else out.otherwise(otherwise)


def pruned(rows: DataFrame, leaves: list[Leaf], top_k: int) -> tuple[list[Leaf], int, list[Leaf]]:
    """The leaves with their numbers of rows and of those the model agrees with, the most frequent class of the others, and the top_k leaves with most rows."""
    told = rows.groupBy(F.coalesce(*[F.when(leaf.holds(), k) for k, leaf in enumerate(leaves)]).alias("leaf"), "mimic").agg(F.count(F.lit(1)).alias("n")).collect()  # leaves x classes
    counted = [replace(leaf, rows=sum(r.n for r in told if r.leaf == k), right=sum(r.n for r in told if r.leaf == k and r.mimic == leaf.told)) for k, leaf in enumerate(leaves)]
    order = sorted(range(len(leaves)), key=lambda k: (-counted[k].rows, k))
    kept, rest = order[:top_k], set(order[top_k:])
    votes: dict[int, int] = {}
    for r in told:
        if not rest or r.leaf in rest:
            votes[r.mimic] = votes.get(r.mimic, 0) + r.n
    return counted, min(votes, key=lambda c: (-votes[c], c)) if votes else 0, [counted[k] for k in sorted(kept)]


@dataclass
class Explanation:
    """leaves, branches (those that pruning keeps) and otherwise (the class beyond them); how a tree agrees with the other rounds' and its reward; measures on windows it wasn't fitted to."""

    leaves: list[Leaf]
    branches: list[Leaf]
    otherwise: int
    agreement: float
    reward: float
    #: (tree, against, class, precision, recall, f1, rows): 'whole' or 'pruned', 'model' or 'truth'; class null: accuracy in f1.
    report: list[tuple]

    def table(self, spark: SparkSession) -> DataFrame:
        """kind ('branch', 'otherwise', 'agreement', 'reward' or a measure), text, class, rows, value."""
        rows = [("branch", leaf.text(), leaf.told, leaf.rows, leaf.right / leaf.rows if leaf.rows else None) for leaf in self.branches]
        rows += [("otherwise", None, self.otherwise, None, None), ("agreement", None, None, None, self.agreement), ("reward", None, None, None, self.reward)]
        rows += [(f"{tree} tree, {against}", "accuracy" if c is None else "f1", c, n, f1) for tree, against, c, _, _, f1, n in self.report]
        return spark.createDataFrame(rows, "kind string, text string, class int, rows long, value double")


def chance(seed: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("window", F.lit(seed), F.lit(salt)), F.lit(1000))


def below(window: np.ndarray, seed: int, salt: int, share: int) -> np.ndarray:
    """Whether each window is of a share, in thousandths, drawn for itself alone."""
    return recurrent.drawn(window, seed * 1_000_003 + salt) < share


def unpacked(batches: Iterable[pa.RecordBatch], features: int, kind: str, mimics: str, rounds: int):
    """window, mimic, x (column, window) and weight (round, window) of each packed row."""
    for batch in batches:
        for window, mimic, x, weight in zip(*(batch.column(c) for c in COLUMNS)):
            window = np.frombuffer(window.as_buffer(), np.int64)
            yield window, np.frombuffer(mimic.as_buffer(), mimics), np.frombuffer(x.as_buffer(), kind).reshape(features, -1), np.frombuffer(weight.as_buffer(), np.uint16).reshape(rounds, -1)


def small(n: int) -> str:
    """The type of numbers below n."""
    return "uint8" if n <= 1 << 8 else "uint16" if n <= 1 << 16 else "int64"


class Rounds:
    """The packed windows with their weight in each outer round, and what is counted over them."""

    def __init__(self, learnt: DataFrame, names: list[str], values: list[np.ndarray], classes: np.ndarray, outer: int, share: int, seed: int):
        self.spark, self.outer, self.share, self.seed, self.classes = learnt.sparkSession, outer, share, seed, len(classes)
        self.features, self.kind, self.mimics = len(names), small(max(map(len, values))), small(len(classes))
        self.widths = np.array([len(v) for v in values])
        self.offsets = np.concatenate([[0], self.widths.cumsum()[:-1]])
        features, kind, mimics = self.features, self.kind, self.mimics

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, PACK):
                    b = batch.slice(at, PACK)
                    window, mimic, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                    x = np.stack([np.searchsorted(v, c) for v, c in zip(values, columns)]).astype(kind)
                    weight = np.stack([below(window, seed + i, 1, share) for i in range(outer)]).astype(np.uint16)
                    yield pa.RecordBatch.from_pydict({"window": [window.astype(np.int64).tobytes()], "mimic": [np.searchsorted(classes, mimic).astype(mimics).tobytes()], "x": [x.tobytes()], "weight": [weight.tobytes()]})

        self.path, self.table = None, None
        self.keep(learnt.select("window", "mimic", *[f"`{n}`" for n in names]).mapInArrow(pack, PACKED))
        self.read = lambda batches: unpacked(batches, features, kind, mimics, outer)

    def keep(self, rows: DataFrame | None) -> None:
        """Stores the windows anew, instead of those there were; with None they only go."""
        old = self.path
        if rows is not None:
            with scratch(self.spark) as paths:
                self.table = stored(self.spark, rows, "packed")
                self.path = paths.pop()
        if old:
            remove(self.spark, [old])

    def counts(self, trees: list[Tree], nodes: list[tuple[int, int]], inner: int) -> np.ndarray:
        """(node, value of each column, class): the weights of the windows that fit a tree, for some nodes (round, node)."""
        read, seed, bins, classes, columns = self.read, self.seed, int(self.widths.sum()), self.classes, [*zip(self.offsets.tolist(), self.widths.tolist())]
        places: dict[int, np.ndarray] = {}
        for k, (i, node) in enumerate(nodes):
            places.setdefault(i, np.full(len(trees[i].feature), -1))[node] = k

        def count(batches):
            out = np.zeros((len(nodes), bins, classes), np.int64)
            for window, mimic, x, weight in read(batches):
                for i, place in places.items():
                    at = np.flatnonzero(weight[i])
                    at = at[~below(window[at], seed + i, 1000 + inner, ASIDE)]
                    node = place[trees[i].nodes(x, at)]
                    at, node = at[node >= 0], node[node >= 0]
                    if not len(at):
                        continue
                    low = int(node.min())
                    span = int(node.max()) + 1 - low
                    key, w = (node - low) * classes + mimic[at], weight[i][at].astype(np.float64)
                    for column, (offset, width) in zip(x, columns):
                        got = np.bincount(column[at].astype(np.int64) * (span * classes) + key, w, width * span * classes)
                        out[low : low + span, offset : offset + width] += got.astype(np.int64).reshape(width, span, classes).transpose(1, 0, 2)
            flat = out.ravel()
            for piece in range(0, len(flat), recurrent.PIECE):
                yield pa.RecordBatch.from_pydict({"run": pa.array([0], pa.int32()), "piece": pa.array([piece // recurrent.PIECE], pa.int32()), "value": [flat[piece : piece + recurrent.PIECE].tobytes()]})

        pieces = recurrent.summed(self.table.select(*COLUMNS).coalesce(recurrent.TASKS).mapInArrow(count, "run int, piece int, value binary")).orderBy("piece").collect()
        return np.concatenate([np.frombuffer(r.value, np.int64) for r in pieces]).reshape(len(nodes), bins, classes)

    def fitted(self, depth: int, inner: int) -> list[Tree]:
        """A tree of each round."""
        trees = [Tree(depth) for _ in range(self.outer)]
        open_, most = [(i, 0) for i in range(self.outer)], max(1, CELLS // (int(self.widths.sum()) * self.classes))
        while open_:
            new = []
            for at in range(0, len(open_), most):
                some = open_[at : at + most]
                for (i, node), told in zip(some, self.counts(trees, some, inner)):
                    new.append((i, node, told))
            open_ = [(i, child) for i, node, told in new for child in trees[i].split(node, told, self.offsets, self.widths)]
        for tree in trees:
            tree.merged()
        return trees

    def measured(self, trees: list[Tree], inner: int, last: bool) -> list[float]:
        """Macro F1 of each round's tree over the windows put aside; unless it is the last time, the windows it gets wrong are weighed more."""
        read, seed, share, classes = self.read, self.seed, self.share, self.classes

        def measure(batches):
            for window, mimic, x, weight in read(batches):
                weight, told = weight.copy(), np.zeros((len(trees), classes, classes), np.int64)
                for i, tree in enumerate(trees):
                    aside, drawn = (weight[i] > 0) & below(window, seed + i, 1000 + inner, ASIDE), below(window, seed + i, 2000 + inner, 0 if last else share)
                    at = np.flatnonzero(aside | drawn)
                    got = tree.told[tree.nodes(x, at)]
                    own = aside[at]
                    told[i] = np.bincount(mimic[at[own]].astype(np.int64) * classes + got[own], minlength=classes * classes).reshape(classes, classes)
                    weight[i, at[drawn[at] & (got != mimic[at])]] += 1
                some = np.flatnonzero(told)
                yield pa.RecordBatch.from_pydict({"window": [window.tobytes()], "mimic": [mimic.tobytes()], "x": [x.tobytes()], "weight": [weight.tobytes()], "cell": pa.array([some.tolist()], pa.list_(pa.int64())), "n": pa.array([told.ravel()[some].tolist()], pa.list_(pa.int64()))})

        new = self.table.select(*COLUMNS).mapInArrow(measure, PACKED + ", cell array<long>, n array<long>")
        if not last:
            self.keep(new)
            new = self.table
        pairs = new.select(F.explode(F.arrays_zip("cell", "n")).alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect()  # rounds x classes x classes
        told = np.zeros(len(trees) * classes * classes, np.int64)
        for r in pairs:
            told[r.cell] = r.n
        out = []
        for t in told.reshape(len(trees), classes, classes):
            both = t.sum(0) + t.sum(1)
            out.append(float(np.mean(2 * t.diagonal()[both > 0] / both[both > 0])) if both.any() else 0.0)
        return out

    def agreement(self, trees: list[Tree]) -> tuple[np.ndarray, int]:
        """How many windows each two trees tell the same of, and of how many."""
        read = self.read

        def agree(batches):
            for window, _, x, _ in read(batches):
                told = np.stack([tree.told[tree.nodes(x)] for tree in trees])
                yield pa.RecordBatch.from_pydict({"pair": pa.array(np.arange(len(trees) ** 2)), "same": pa.array((told[:, None] == told[None]).sum(-1).ravel().astype(np.int64)), "n": pa.array(np.full(len(trees) ** 2, len(window)))})

        rows = self.table.select(*COLUMNS).mapInArrow(agree, "pair long, same long, n long").groupBy("pair").agg(F.sum("same").alias("same"), F.sum("n").alias("n")).orderBy("pair").collect()
        return np.array([r.same for r in rows]).reshape(len(trees), -1), rows[0].n


def explain(flat: DataFrame, names: list[str], outer: int = 10, inner: int = 50, share: float = 0.3, depth: int = 6, top_k: int = 10, seed: int = 7) -> Explanation:
    """flat: window, mimic, truth and the named columns, which have few values each."""
    spark = flat.sparkSession
    ship(spark)
    every = stored(spark, flat, "windows")
    learnt, kept_back = every.filter(chance(seed, 0) >= TEST), every.filter(chance(seed, 0) < TEST)
    told = learnt.agg(*[F.sort_array(F.collect_set(F.col(f"`{n}`"))).alias(f"v{k}") for k, n in enumerate(["mimic", *names])]).first()  # the codes of a column
    classes, *values = (np.array(v, np.int64) for v in told)
    if not len(classes):
        return Explanation([], [], 0, 0.0, 0.0, [])
    rounds = Rounds(learnt, names, values, classes, outer, int(1000 * share), seed)
    best: list[tuple[float, Tree] | None] = [None] * outer
    for j in range(inner):
        trees = rounds.fitted(depth, j)
        found = list(zip(rounds.measured(trees, j, j + 1 == inner), trees))
        best = [new if new[1].rows and (old is None or new[0] > old[0]) else old for old, new in zip(best, found)]
    best = [b for b in best if b]  # the rounds that drew windows
    same, n = rounds.agreement([tree for _, tree in best]) if best else (None, 0)
    rounds.keep(None)
    if not best:
        return Explanation([], [], 0, 0.0, 0.0, [])
    mean = [(same[a].sum() - n) / n / (len(best) - 1) if len(best) > 1 else 1.0 for a in range(len(best))]
    at = max(range(len(best)), key=lambda k: (mean[k], best[k][0], -k))
    reward, leaves = best[at][0], best[at][1].leaves(names, values, classes)
    leaves, otherwise, branches = pruned(learnt, leaves, top_k)
    report = []
    for tree, told in (("whole", told_by(leaves)), ("pruned", told_by(branches, otherwise))):
        for against, actual in (("model", "mimic"), ("truth", "truth")):
            counts = stored(spark, metrics.counts(kept_back.filter(F.col(actual) >= 0).select(F.col(actual).alias("actual"), told.alias("predicted"))), "counts")
            by = metrics.per_class(counts).orderBy("class").collect()  # a row a class
            report += [(tree, against, r["class"], r.precision, r.recall, r.f1, r.actual_n) for r in by]
            n = sum(r.actual_n for r in by)
            report.append((tree, against, None, None, None, sum(r.tp for r in by) / n if n else None, n))
    return Explanation(leaves, branches, otherwise, float(mean[at]), float(reward), report)
