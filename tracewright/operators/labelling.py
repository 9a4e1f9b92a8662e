"""What a labeller is shown beside a record that has no label yet: labels it might have, what follows, how far others are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import UNKNOWN
from ..functions.labels import propose
from ..session import stored
from .windows import in_chunks

#: The record's own label if it had another verb.
OTHER_VERBS = {"create_label": "create", "delete_label": "delete", "watch_label": "watch", "patch_label": "patch"}
#: What is looked for within the next LOOK records; a user's action within the next FAR.
NEXT_VERBS = {"next_watch": ("watch",), "next_create": ("create",), "next_patch": ("patch", "update"), "next_delete": ("delete", "deletecollection")}
LOOK, FAR, AFTER = 19, 39, 4


def first_after(w: Window, wanted: Column, rows: int, name: str) -> list[Column]:
    """The proposal of the first of the next rows that is wanted (-1 if none is), and how many lines ahead it stands (null)."""
    found = F.first(F.when(wanted, F.struct("proposal", "_i")), ignorenulls=True).over(w.rowsBetween(1, rows))
    return [F.coalesce(found["proposal"], F.lit(UNKNOWN)).alias(name), (found["_i"] - F.col("_i")).alias(f"{name}_after")]


def context(records: DataFrame, open_only: bool = True) -> DataFrame:
    """line_idx, proposal, the labels with other verbs, what comes next in the log, and the distances to the record before and the four after.

    Wants what propose() wants, line_idx, ts_us, username, label and cplabel (null: not marked). The log is one sequence. A user's action
    is a record that isn't marked as the control plane's and whose user isn't the system's. Distances are without sign, null where there is no record;
    the first record's is the one to the last record, as if the log went round. Records that have a label other
    than -1 are looked at by others, but left out themselves.
    """
    told = propose(records, OTHER_VERBS).select("line_idx", "ts_us", "verb", F.coalesce(F.col("cplabel"), F.lit(False)).alias("marked"), F.coalesce(F.col("username").startswith("system:"), F.lit(False)).alias("system"), (F.col("label").isNull() | (F.col("label") == UNKNOWN)).alias("open"), "proposal", *OTHER_VERBS)
    told = stored(records.sparkSession, told, "told")  # read by the sample of the ranges, their rows and the last record
    rows, w, own = in_chunks(told, [], ["line_idx"], behind=1, ahead=FAR)
    last = told.agg(F.max_by("ts_us", "line_idx").alias("last_us"))
    looks = [c for name, verbs in NEXT_VERBS.items() for c in first_after(w, F.col("verb").isin(*verbs), LOOK, name)]
    looks += first_after(w, ~F.col("marked") & ~F.col("system"), FAR, "next_action")
    near = [F.abs(F.lag("ts_us").over(w) - F.col("ts_us")).alias("before_us"), *[F.abs(F.lead("ts_us", k).over(w) - F.col("ts_us")).alias(f"after{k}_us") for k in range(1, AFTER + 1)]]
    out = rows.select("line_idx", "_i", "ts_us", "open", own.alias("mine"), "proposal", *OTHER_VERBS, *looks, *near).filter(F.col("mine") & (F.col("open") | F.lit(not open_only)))
    out = out.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("before_us", F.when(F.col("_i") == 0, F.abs(F.col("last_us") - F.col("ts_us"))).otherwise(F.col("before_us"))).drop("_i", "ts_us", "open", "mine", "last_us")
