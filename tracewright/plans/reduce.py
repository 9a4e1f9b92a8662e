"""Raw log to reduced log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

MODES = {"labelling": ("removed", "blacklisted", "whitelisted"), "reduction": ("whitelisted",), "light": ("whitelisted", "blacklisted")}


def reduced(records: DataFrame, mode: str = "reduction", off: tuple[str, ...] = ()) -> DataFrame:
    """The records that a mode keeps, with their decision."""
    decided = records.withColumn("decision", rules.noise_decision(off))
    return decided.filter(decided["decision"].isin(*MODES[mode]))


def tally(records: DataFrame, total: str, off: tuple[str, ...] = ()) -> DataFrame:
    """mode, n and the sum of a column over the records that each mode keeps; every record is decided once, for all modes."""
    decided = records.withColumn("decision", rules.noise_decision(off))
    kept = {m: F.col("decision").isin(*of) for m, of in MODES.items()}
    one = decided.agg(*[F.count_if(k).alias(f"n_{m}") for m, k in kept.items()], *[F.sum(F.when(k, F.col(total))).alias(f"total_{m}") for m, k in kept.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"n_{m}").alias("n"), F.col(f"total_{m}").alias("total")) for m in MODES])))
