"""The pipeline's stages, each against a plain rule on its own input."""

import collections
import os
import re
import zlib

import numpy as np
import pytest
from test_operators import BENCH, brute_components, lower, rows, shingle_set

import corpus_pipeline
from tracewright.llm import common, decontaminate, near_dedup, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.load(spark, SF, "documents")
    columns = docs.columns
    model = toxicity.train(docs, common.load(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.stored(spark, stage(spark, docs, SF), "test")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        table = spark.createDataFrame(list(before.items()), "doc_id long, text string")
        if name == "toxicity":
            assert before.keys() - after.keys() == {r.doc_id for r in toxicity.scores(table, model).collect() if r.predicted}
        elif name == "exact dedup":
            keep = {}
            for i, t in sorted(before.items()):
                keep.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert after.keys() == set(keep.values())
        elif name == "near dedup":
            assert after.keys() == {r.doc_id for r in near_dedup.near_duplicates(table).collect() if r.kept}
        else:
            assert after.keys() == {r.doc_id for r in decontaminate.contamination(table, common.load(spark, SF, "benchmark")).collect() if not r.contaminated}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert len(pieces) > 0 and corpus_pipeline.run(spark, SF).count() == len(pieces)


FOUL = "you are all grubbly snarkish vermin"


def written(spark, folder, documents, labels):
    odd = "doc_id long, text string, row_key string, Row_Turn string, gone_id string, kept boolean, chunk int, part int"
    spark.createDataFrame([(i, t, "a", "b", "c", True, k, None) for k, (i, t) in enumerate(documents)], odd).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def clean(told):
    """What the stages after toxicity leave, by plain rules."""
    groups = collections.defaultdict(list)
    for i, t in told:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((float("inf") if i is None else i, t))
    unique = [(None if i == float("inf") else i, t) for i, t in (min(g, key=lambda x: x[0]) for g in groups.values())]
    real = [x for x in unique if x[0] is not None]
    stays = {i for (i, _), c in zip(real, brute_components([(i, shingle_set(t)) for i, t in real])) if i == c} | {None}
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for _, t in BENCH:
        w = word.findall(lower(t or ""))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}

    def hit(t):
        w = word.findall(lower(t or ""))
        return any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))

    return [(i, t) for i, t in unique if i in stays and not hit(t)]


@pytest.mark.parametrize("case", ["no labels", "labels", "nothing"])
def test_awkward_rows(spark, tmp_path, case):
    more = [(7000 + k, f"{FOUL} number{k} of{k} them{k}" if k % 4 == 0 else f"a plain line{k} of words{k} for number{k}") for k in range(240)]
    told = {"no labels": rows() + more[:10], "labels": rows() + more, "nothing": []}[case]
    labels = [(i, 1, int(FOUL in t)) for i, t in more] if case == "labels" else []
    sf = written(spark, tmp_path, told, labels + [(None, None, None)] * 2)
    foul = {i for i, t in told if FOUL in (t or "")} if case == "labels" else set()
    t = tokens.Tokenizer.from_file(common.vocabulary_path(tokens.VOCABULARY))
    want = collections.Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 2) for i, x in clean([x for x in told if x[0] not in foul]))
    pieces = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert len(want) > 20 if told else not pieces
    at, done = 0, []
    for r in pieces:
        assert r.sequence_id * packing.LENGTH + r.offset == at and r.length > 0
        at += r.length
        if r.start + r.length == r.doc_tokens:
            done.append((r.doc_id, r.doc_tokens))
    assert collections.Counter(done) == collections.Counter((x[0], len(x) - 1) for x in want.elements())
    whole = collections.Counter((r.doc_id, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
    assert not whole - collections.Counter((x[0], zlib.crc32(np.array(x[1:], "<u4").tobytes())) for x in want.elements())


def test_stages_leave_nothing_behind(spark):
    at = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(x.split("-")[0] for x in set(os.listdir(at)) - before) == ["stage", "tokens"]
