"""The corpus pipeline: toxic documents go, then exact copies, near copies and contaminated documents; the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return
the columns of documents; their rows are written as Parquet and read again as the next stage's docs. What a stage has
stored for itself, and the rows it has read, are deleted once its own rows are written.

Columns beside doc_id and text pass through whatever they are called. A null text counts as empty: it isn't toxic, not
contaminated and near to nothing, but a copy of other empty texts, of which one stays and is packed as its end mark. A null
doc_id is larger than all others for exact dedup and has no near copies. Rows that repeat a doc_id are documents of their
own; as near copies they stay together if one stays. An empty table gives no pieces; no labels, no toxic documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from tracewright.llm.common import load, stored
from tracewright.session import scratch


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_copies_out), ("near dedup", near_copies_out), ("decontamination", contaminated_out), ("packing", pack)]

#: Learned scores, token ids and near-duplicate components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = load(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs = stored(spark, stage(spark, docs, sf_dir), "stage")
            read, tables[:] = tables[-1:], read + tables[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
