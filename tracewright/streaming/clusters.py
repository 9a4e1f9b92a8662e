"""Clusters as a log grows: windows are kept as state by label, and given out as clusters once the watermark has passed them.

A label's records wait in its state, in line order. The first one opens a window that takes records within the limit of it, as
in batches. When the watermark has passed the window's end, nothing that belongs in it can come any more: it is
resolved by the same scorer as in batches and leaves the state, and the next record opens the next window. So what is held is the
records of each label within the limit and the lateness, however long the log is. A full window closes as
soon as the watermark has passed its records. Records later than the watermark are dropped, those without label or
timestamp have no place in a stream of windows.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators.clustering import CONTROL_PLANE, OPTIONAL, assign, cluster_id, is_trigger, with_optional
from ..operators.windows import LIMIT_US, MOST_ROWS
from ..session import ship, shared_dir

COLUMNS = ["line_idx", "label", "ts_us", "trigger", "cp", "username", "verb", "resource", "namespace", "name", *OPTIONAL]
OUT = "line_idx long, label int, window_start long, first string"
#: Rows given out at once, and at most those of a window more.
OUT_ROWS = 10_000


def closed(held: list[dict], watermark_us: int, limit_us: int = LIMIT_US, most: int = MOST_ROWS) -> tuple[list[list[dict]], list[dict]]:
    """The windows that nothing can join any more, and the records that stay. held: in line order."""
    out, at = [], 0
    while at < len(held):
        end, t0 = at, held[at]["ts_us"]
        while end < len(held) and end - at < most and held[end]["ts_us"] - t0 <= limit_us:
            end += 1
        full = end - at == most and max(r["ts_us"] for r in held[at:end]) < watermark_us
        if not full and t0 + limit_us >= watermark_us:
            break
        out.append(held[at:end])
        at = end
    return out, held[at:]


def light(text: str) -> dict:
    """What tells a record's window, and its JSON as it is: a record is taken apart only with the window that it leaves in."""
    r = json.loads(text)
    return {"line_idx": r["line_idx"], "ts_us": r["ts_us"], "text": text}


def resolved(text: str) -> dict:
    """A record out of its JSON, as the scorer takes it."""
    r = json.loads(text)
    r = {c: r.get(c) for c in COLUMNS}
    r["owner_uids"] = r["owner_uids"] or []
    for c, names in (("involved", ("kind", "namespace", "name", "resource")), ("claim", ("kind", "namespace", "name"))):
        r[c] = r[c] and tuple(r[c].get(n) for n in names)
    return r


def cluster_stream(records: DataFrame, late: str = "60 seconds", merge: bool = False, limit_us: int = LIMIT_US, most: int = MOST_ROWS) -> DataFrame:
    """line_idx, label, window_start, cluster_id of the records of a stream, append only. Wants ts_us, label, proposal and the record's columns."""
    ship(records.sparkSession)
    marked = with_optional(records.filter("label IS NOT NULL AND ts_us IS NOT NULL").withColumns({"trigger": is_trigger(), "cp": rules.control_plane_code()}))
    slim = marked.select("label", F.timestamp_micros("ts_us").alias("at"), F.to_json(F.struct(*COLUMNS)).alias("record")).withWatermark("at", late)

    def keep(key, batches, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else []
        held += [text for batch in batches for text in batch["record"]] if not state.hasTimedOut else []
        rows = sorted(map(light, held), key=lambda r: r["line_idx"])
        del held
        passed = state.getCurrentWatermarkMs()
        windows, rest = closed(rows, passed * 1000, limit_us, most)
        del rows
        if rest:
            state.update((json.dumps([r["text"] for r in rest]),))
            state.setTimeoutTimestamp(max(passed, (rest[0]["ts_us"] + limit_us) // 1000) + 1)
        elif state.exists:
            state.remove()
        out: list[tuple] = []
        for k, w in enumerate(windows):
            out += [(line, key[0], w[0]["line_idx"], first) for line, first in assign([resolved(r["text"]) for r in w], merge).items()]
            windows[k] = None
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=["line_idx", "label", "window_start", "first"])
                out = []
        yield pd.DataFrame(out, columns=["line_idx", "label", "window_start", "first"])

    found = slim.groupBy("label").applyInPandasWithState(keep, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("line_idx", "label", "window_start", F.when(F.col("first") == CONTROL_PLANE, CONTROL_PLANE).otherwise(cluster_id(F.col("first"))).alias("cluster_id"))


def run(spark: SparkSession, source: str, schema, out: str | None = None, **how) -> DataFrame:
    """Clusters of the record files that lie in a folder by now, appended to a table that grows with each run; state and progress lie beside it."""
    out = out or f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    files = spark.readStream.schema(schema).parquet(source)
    made = cluster_stream(files, **how)
    made.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("line_idx long, label int, window_start long, cluster_id string").parquet(out)
