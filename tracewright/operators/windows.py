"""Time windows anchored at data, gaps, compaction and sequences, none of which needs all rows of a key in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored, unused

LIMIT_US, MOST_ROWS, GAP_LEFT_US = 300_000_000, 1000, 60_000_000
#: Rows of a chunk of a key's rows in order.
CHUNK = 1 << 16
#: Rows of a range, which one task takes as a whole.
RANGE_ROWS = 1 << 20


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, key: list[str], order: list[str], part: str = "_part") -> DataFrame:
    """df, dealt by ranges of (key, order) and stored with the range's number: numbers that stay what they are when read again.

    A range has about RANGE_ROWS rows at most: where the session's number of partitions gives larger ones, what is stored is dealt again.
    """
    def dealt(rows: DataFrame, parts: int) -> DataFrame:
        return stored(df.sparkSession, rows.repartitionByRange(parts, *key, *order).withColumn(part, F.spark_partition_id()), "ranges")

    rows, parts = dealt(df, parts_of(df)), parts_of(df)
    told = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (told.most or 0) > RANGE_ROWS:
        rows = dealt(rows.drop(part), max(parts + 1, math.ceil(1.5 * told["all"] / RANGE_ROWS)))  # ranges are cut by a sample
    return rows


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Adds 0, 1, ... in order within each key: counted by range, then offset by what the ranges before hold. Other columns may have any names."""
    part, at = unused(df, "_part"), unused(df, "_local")
    rows = ranged(df, key, order, part)
    names = {x: unused(df, f"_{x}") for x in ("n", "p", "before", *(f"k{j}" for j in range(len(key))))}
    counts = rows.groupBy(*key, part).agg(F.count(F.lit(1)).alias(names["n"]))
    w = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a key is in
    told = counts.withColumn(names["before"], F.coalesce(F.sum(names["n"]).over(w), F.lit(0)))
    before = told.select(*[F.col(k).alias(names[f"k{j}"]) for j, k in enumerate(key)], F.col(part).alias(names["p"]), names["before"])
    same = F.col(part) == F.col(names["p"])
    for j, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(names[f"k{j}"]))
    local = F.row_number().over(Window.partitionBy(*key, part).orderBy(*order)) - 1
    out = rows.withColumn(at, local).join(before, same)
    number = (F.col(at) + F.col(names["before"])).cast("long").alias(name)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], number)


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """Adds i = 0, 1, ... in that order over all rows."""
    return numbered(df, [], list(order))


def in_chunks(df: DataFrame, key: list[str], order: list[str], behind: int = 0, ahead: int = 0, size: int = CHUNK) -> tuple[DataFrame, Window, Column]:
    """Rows dealt to chunks of `size` in order, a window over a chunk, and what tells a chunk's own rows.

    A chunk also holds the `behind` rows before it and the `ahead` rows after it, so that frames of that reach are whole.
    """
    if max(behind, ahead) > size:
        raise ValueError("frames reach further than a chunk")
    rows = numbered(df, key, order, "_i")
    own, at = F.floor(F.col("_i") / size), F.col("_i") % size
    others = F.array_compact(F.array(own, F.when(at < ahead, own - 1), F.when(at >= size - behind, own + 1)))
    dealt = rows.withColumn("_own", own).withColumn("_chunk", F.explode(others))
    return dealt, Window.partitionBy(*key, "_chunk").orderBy("_i"), F.col("_own") == F.col("_chunk")


def gap_ids(df: DataFrame, key: list[str], ts: str = "ts_us", order: str = "line_idx", limit_us: int = LIMIT_US) -> DataFrame:
    """Adds gap_id: how many gaps beyond the limit lie before the row. A gap always opens a window, so windows never cross these groups (for timestamps that don't fall)."""
    rows, w, own = in_chunks(df, key, [order], behind=1)
    jump = F.coalesce((F.col(ts) - F.lag(ts).over(w) > limit_us).cast("long"), F.lit(0))
    return running(rows.withColumn("_jump", jump).filter(own), key, "_jump", "gap_id").drop("_jump")


def running(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over a row and those before it, of rows of in_chunks() without the repeated ones."""
    totals = rows.groupBy(*key, "_own").agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*key).orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(w), F.lit(0))).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)], F.col("_own").alias("_c"), "_before")
    same = F.col("_own") == F.col("_c")
    for j, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    here = F.sum(value).over(Window.partitionBy(*key, "_own").orderBy("_i"))
    return rows.withColumn("_here", here).join(before, same).withColumn(name, F.col("_here") + F.col("_before")).drop("_here", "_before", "_c", "_i", "_own", "_chunk", *[f"_k{j}" for j in range(len(key))])


def next_starts(t: np.ndarray, limit_us: int, most: int) -> np.ndarray:
    """Where the next window starts if one starts at each place; len(t) or more if none does."""
    n = len(t)
    if n < 2 or (t[1:] >= t[:-1]).all():
        return np.minimum(np.searchsorted(t, t + limit_us, "right"), np.arange(n) + most)
    # Timestamps fall somewhere: the highest of 1, 2, 4, ... rows from each place; then past all runs of rows, longest first, that don't go beyond the limit.
    highest, k = [t], 1
    while 2 * k <= min(most, n):
        highest.append(np.maximum(highest[-1], np.append(highest[-1][k:], np.full(k, np.iinfo(np.int64).max))))
        k *= 2
    at, last = np.arange(n), np.minimum(np.arange(n) + most, n)
    for j in (len(highest) - 1, *range(len(highest) - 1, -1, -1)):
        k = 1 << j
        fits = at + k <= last
        fits[fits] = highest[j][at[fits]] <= t[fits] + limit_us
        at[fits] += k
    return np.where(at < last, at, np.arange(n) + most)


def entry(t: np.ndarray, t0: int, count: int, limit_us: int, most: int) -> int:
    """How many of the rows a window that is open already still takes."""
    late = np.flatnonzero(t[: most - count] - t0 > limit_us)
    return int(late[0]) if len(late) else min(len(t), most - count)


def anchored_windows(df: DataFrame, key: list[str], ts: str = "ts_us", order: str = "line_idx", limit_us: int = LIMIT_US, most: int = MOST_ROWS) -> DataFrame:
    """(key, order, window_start): the order value of the window's first row, for each row of a window.

    A window takes rows while they are within limit_us of its first row and it has fewer than `most`. Rows without
    a timestamp belong to the window whose first and last row they lie between, others of them to none (they don't
    come out). A key's rows may be spread over many ranges: each range tells, for every row that a window could
    start with at its beginning, with which row its last window would start; these tables are followed range by range,
    one row each, and each range then cuts its own rows from where it is entered.
    """
    ship(df.sparkSession)
    rows = ranged(df.select(*key, F.col(order).alias("_order"), F.col(ts).alias("_t")), key, ["_order"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def sorted_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("_order")
        column = table.column("_t")
        known = column.is_valid().to_numpy()
        return table.column("_order").to_numpy().astype(np.int64), known, column.drop_null().to_numpy().astype(np.int64)

    def fixed(table: pa.Table, **columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({k: pa.repeat(table.column(k)[0], n) for k in key} | columns)

    def told(table: pa.Table) -> pa.Table:
        line, known, t = sorted_rows(table)
        line, at = line[known], next_starts(t, limit_us, most)
        last = np.where(at < len(t), at, np.arange(len(t)))
        while not np.array_equal(last[last], last):  # follow the windows to the last one
            last = last[last]
        head = last[:most]
        return fixed(table, _part=pa.array([table.column("_part")[0].as_py()], pa.int32()), n=[len(t)], head=pa.array([t[:most]], pa.list_(pa.int64())), line=pa.array([line[head]], pa.list_(pa.int64())), t0=pa.array([t[head]], pa.list_(pa.int64())), size=pa.array([len(t) - head], pa.list_(pa.int64())))

    tables = stored(df.sparkSession, rows.groupBy(*key, "_part").applyInArrow(told, f"{keys}, _part int, n long, head array<long>, line array<long>, t0 array<long>, size array<long>"), "windows")

    def follow(table: pa.Table) -> pa.Table:
        ranges = table.sort_by("_part").select(["_part", "n", "head", "line", "t0", "size"]).to_pylist()
        out, open_, waiting = [], None, []
        for r in ranges:
            row = {"_part": r["_part"], "start": open_[0] if open_ else None, "taken": 0, "tail": False}
            if r["n"]:
                taken = entry(np.array(r["head"], np.int64), open_[1], open_[2], limit_us, most) if open_ else 0
                for w in waiting:
                    w["tail"] = taken > 0
                waiting, row["taken"] = [], taken
                if taken < r["n"]:
                    open_ = (r["line"][taken], r["t0"][taken], r["size"][taken])
                else:
                    open_ = (open_[0], open_[1], open_[2] + r["n"])
            waiting.append(row)
            out.append(row)
        return fixed(table, **{k: pa.array([r[k] for r in out], kind) for k, kind in (("_part", pa.int32()), ("start", pa.int64()), ("taken", pa.int64()), ("tail", pa.bool_()))})

    entered = tables.groupBy(*key).applyInArrow(follow, f"{keys}, _part int, start long, taken long, tail boolean")

    def cut(table: pa.Table, how: pa.Table) -> pa.Table:
        how = how.to_pylist()[0]
        line, known, t = sorted_rows(table)
        valid = line[known]
        start = np.full(len(valid), -1 if how["start"] is None else how["start"], np.int64)
        at, a = next_starts(t, limit_us, most), how["taken"]
        while a < len(valid):  # a step a window, not a row
            start[a : at[a]] = valid[a]
            a = int(at[a])
        before = np.cumsum(known) - known  # rows with a timestamp before each row
        out, ok = np.empty(len(line), np.int64), known.copy()
        out[known] = start
        for j in np.flatnonzero(~known):
            b = before[j]
            left = start[b - 1] if b else how["start"]
            inside = left is not None and (start[b] == left and (b > 0 or how["taken"] > 0) if b < len(valid) else how["tail"])
            ok[j], out[j] = inside, left if inside else 0
        if not ok.any():
            return fixed(table.slice(0, 1), _order=pa.array([], pa.int64()), window_start=pa.array([], pa.int64()))
        return fixed(table, _order=line[ok], window_start=out[ok])

    found = rows.groupBy(*key, "_part").cogroup(entered.groupBy(*key, "_part")).applyInArrow(cut, f"{keys}, _order long, window_start long")
    return found.withColumnRenamed("_order", order)


def gap_shift(w: Window, ts: str = "ts_us", limit_us: int = LIMIT_US, left_us: int = GAP_LEFT_US) -> Column:
    """What compaction takes off a record's timestamps: each earlier gap beyond the limit shrinks to left_us."""
    gap = F.col(ts) - F.lag(ts).over(w)
    return F.when(gap > limit_us, gap - left_us).otherwise(0)


def compacted(df: DataFrame, key: tuple[str, ...] = (), limit_us: int = LIMIT_US, left_us: int = GAP_LEFT_US, stamps: tuple[str, ...] = ("ts_us",)) -> DataFrame:
    """Adds shift_us and compact_us, and compact_<name> for further timestamps. key: the log a record belongs to; none: all is one log."""
    rows, w, own = in_chunks(df, list(key), ["line_idx"], behind=1)
    out = running(rows.withColumn("_s", gap_shift(w, stamps[0], limit_us, left_us)).filter(own), list(key), "_s", "shift_us").drop("_s")
    return out.withColumns({("compact_us" if k == 0 else f"compact_{c}"): F.col(c) - F.col("shift_us") for k, c in enumerate(stamps)})


def sequences(df: DataFrame, width: int, key: list[str], order: str = "line_idx", columns: tuple[str, ...] = ("user_id", "k")) -> DataFrame:
    """Every run of `width` consecutive rows of a key as arrays, named by its first row."""
    rows, w, own = in_chunks(df.select(*{*key, order, *columns}), key, [order], ahead=width - 1)
    frame = w.rowsBetween(0, width - 1)
    out = rows.select(*key, order, own.alias("_mine"), *[F.collect_list(c).over(frame).alias(f"_{c}") for c in columns])
    return out.filter(F.col("_mine") & (F.size(f"_{columns[0]}") == width)).select(*key, order, *[F.col(f"_{c}").alias(c) for c in columns])


def folds(df: DataFrame, k: int, index: str = "i") -> DataFrame:
    """Contiguous folds over 0..n-1; the first n mod k have one more."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    cut = extra * (small + 1)
    fold = F.when(F.col(index) < cut, F.floor(F.col(index) / (small + 1))).otherwise(extra + F.floor((F.col(index) - cut) / F.greatest(small, F.lit(1))))
    return df.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("long")).drop("n")  # n is one row


def lookahead(w: Window, condition: Column, rows: int, value: Column) -> Column:
    """The value of the first of the next rows for which the condition holds."""
    return F.first(F.when(condition, value), ignorenulls=True).over(w.rowsBetween(1, rows))


def timeline(df: DataFrame, width: int = 1500) -> DataFrame:
    """x (pixels) and row of each record, 5 % padding on both sides, and the number of ticks."""
    span = df.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    users = row_numbers(df.select("username").distinct(), "username").withColumnRenamed("i", "user_row")
    pad = (F.col("hi") - F.col("lo")) * 0.05
    x = (F.col("ts_us") - (F.col("lo") - pad)) / F.greatest(F.col("hi") - F.col("lo") + 2 * pad, F.lit(1.0)) * width
    ticks = F.lit(max(10, min(50, width // 150)))
    return df.crossJoin(F.broadcast(span)).join(users, "username").withColumns({"x": x, "ticks": ticks}).drop("lo", "hi")
