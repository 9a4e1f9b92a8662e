"""The tree that stands for a model: names, branches, agreement, fidelity."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import recurrent, surrogate
from tracewright.operators.network import Shape

NAMES = ["a_t0", "b_t0", "a_t1", "b_t1"]


def flat(spark, n=1200):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        a0, b0, a1, b1 = (rng.randrange(6) for _ in range(4))
        mimic = 2 if a0 > 3 else int(b1 <= 1)
        rows.append((k, mimic, mimic if k % 10 else (mimic + 1) % 3 if k % 20 else -1, a0, b0, a1, b1))
    return spark.createDataFrame(rows, "window long, mimic int, truth int, a_t0 int, b_t0 int, a_t1 int, b_t1 int"), rows


def tell(leaves, row, otherwise=None):
    at = dict(zip(NAMES, row[3:]))
    for leaf in leaves:
        if all((at[c] <= v) == most for c, most, v in leaf.path):
            return leaf.told
    return otherwise


def test_explains_a_rule(spark):
    df, rows = flat(spark)
    told = surrogate.explain(df.repartition(3), NAMES, outer=2, inner=2, share=0.5, depth=3, top_k=2)
    assert all(tell(told.leaves, r) == r[1] for r in rows) and told.agreement == 1.0 and told.reward == 1.0
    assert {c for leaf in told.leaves for c, _, _ in leaf.path} == {"a_t0", "b_t1"}
    measure = {(tree, against): (f1, n) for tree, against, c, _, _, f1, n in told.report if c is None}
    held = {r.window for r in df.filter(surrogate.chance(7, 0) < surrogate.TEST).collect()}
    assert measure["whole", "model"] == (1.0, len(held))
    known = [r for r in rows if r[0] in held and r[2] >= 0]
    assert measure["whole", "truth"] == (sum(r[1] == r[2] for r in known) / len(known), len(known))
    # The two largest branches stay, the rest is what is most frequent there.
    sizes = sorted((leaf.rows for leaf in told.leaves), reverse=True)
    assert sorted((leaf.rows for leaf in told.branches), reverse=True) == sizes[:2] and sum(sizes) == len(rows) - len(held)
    assert all(leaf.rows == leaf.right == sum(1 for r in rows if r[0] not in held and tell([leaf], r) is not None) for leaf in told.leaves)
    held_rows = [r for r in rows if r[0] in held]
    right = sum(tell(told.branches, r, told.otherwise) == r[1] for r in held_rows)
    assert measure["pruned", "model"][0] == right / len(held_rows)
    table = told.table(spark).collect()
    assert sum(r.kind == "branch" for r in table) == 2 and all("_t" in r.text for r in table if r.kind == "branch")


def test_one_class_and_nothing(spark):
    df, _ = flat(spark, 50)
    told = surrogate.explain(df.withColumn("mimic", F.lit(1)), NAMES, outer=1, inner=1)
    assert [leaf.text() for leaf in told.leaves] == ["always"] and told.otherwise == 1 and told.agreement == 1.0
    assert surrogate.explain(df.limit(0), NAMES, outer=1, inner=1).leaves == []


def test_windows_of_a_model(spark):
    log = spark.createDataFrame([(k, "get" if k % 3 else "list", k % 2) for k in range(40)], "line_idx long, verb string, y int")
    data = recurrent.blocks(log, ["verb"], [F.col("y")], 4, steps=2, buckets=8, size=8)
    run = recurrent.Run("raw", Shape(1, 4, buckets=8, embed=4, hidden=4, parts=1, classes=2))
    df, names = surrogate.flat_windows(data, run, ["verb"])
    assert names == ["verb_t0", "verb_t1", "verb_t2", "verb_t3"]
    rows = {r.window: r for r in df.collect()}
    code = {"get": 2, "list": 3}
    assert sorted(rows) == list(range(37)) and all([r[n] for n in names] == [code["get" if (w + t) % 3 else "list"] for t in range(4)] and r.truth == w % 2 for w, r in rows.items())


def test_the_query_leaves_nothing_out(spark, monkeypatch):
    from tracewright import registry

    asked = {}

    def explain(flat, names, outer=10, inner=50, share=0.3, depth=6, top_k=10, seed=7):
        asked.update(outer=outer, inner=inner, share=share, depth=depth, top_k=top_k)
        return surrogate.Explanation([], [], 0, 0.0, 0.0, [])

    def train(data, runs, until=recurrent.EPOCHS, **how):
        asked.update(until=until)
        return runs

    monkeypatch.setattr(surrogate, "explain", explain)
    monkeypatch.setattr(recurrent, "train", train)
    registry.d19_tree_surrogate(spark, "/root/testdata/sf0.001")
    assert asked == {"until": recurrent.EPOCHS, "outer": 10, "inner": 50, "share": 0.3, "depth": 6, "top_k": 10}


def test_counts_and_weights_of_rounds(spark, monkeypatch):
    rng, classes, outer = random.Random(2), 3, 2
    rows = [(k, rng.randrange(classes), 0, rng.randrange(300), rng.randrange(200)) for k in range(700)]
    df = spark.createDataFrame(rows, "window long, mimic int, truth int, a_t0 int, b_t0 int").repartition(3)
    values = [np.array(sorted({r[c] for r in rows})) for c in (3, 4)]
    monkeypatch.setattr(surrogate, "PACK", 64)
    rounds = surrogate.Rounds(df, ["a_t0", "b_t0"], values, np.arange(classes), outer, 300, 7)
    drawn = lambda w, i, salt, share: bool(surrogate.below(np.array([w]), 7 + i, salt, share)[0])
    weight = {(i, r[0]): int(drawn(r[0], i, 1, 300)) for i in range(outer) for r in rows}
    for j in range(2):
        trees = rounds.fitted(3, j)
        nodes = [(i, n) for i in range(outer) for n in (0, 1, 2)]
        got, want = rounds.counts(trees, nodes, j), np.zeros((len(nodes), sum(map(len, values)), classes), np.int64)
        tell = {}
        for i, tree in enumerate(trees):
            for r in rows:
                at, path = 0, [0]
                while tree.feature[at] >= 0:
                    at = 2 * at + 1 + int(values[tree.feature[at]].searchsorted(r[3 + tree.feature[at]]) > tree.cut[at])
                    path.append(at)
                tell[i, r[0]] = tree.told[at]
                if weight[i, r[0]] and not drawn(r[0], i, 1000 + j, surrogate.ASIDE) and path[-1] in (0, 1, 2):
                    for c, offset in ((0, 0), (1, len(values[0]))):
                        want[nodes.index((i, path[-1])), offset + values[c].searchsorted(r[3 + c]), r[1]] += weight[i, r[0]]
        assert (got == want).all()
        f1 = rounds.measured(trees, j, False)
        for i in range(outer):
            aside = [r for r in rows if weight[i, r[0]] and drawn(r[0], i, 1000 + j, surrogate.ASIDE)]
            hits = [2 * sum(r[1] == c == tell[i, r[0]] for r in aside) / max(1, sum(r[1] == c for r in aside) + sum(tell[i, r[0]] == c for r in aside)) for c in range(classes)]
            assert abs(f1[i] - sum(hits) / classes) < 1e-12
            for r in rows:
                weight[i, r[0]] += drawn(r[0], i, 2000 + j, 300) and tell[i, r[0]] != r[1]
    rounds.keep(None)
