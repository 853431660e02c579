"""Live against offline features (V1-V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snap_anchor(trades: DataFrame, width: str = "10 seconds") -> DataFrame:
    """V1: the last trade's time in each bar."""
    return trades.groupBy("asset", F.window("time", width)["start"].alias("bar")).agg(F.max("time").alias("anchor"))


def parity_ledger(offline: DataFrame, live: DataFrame, features: list[str], scales: tuple[int, ...] = (10, 60, 300)) -> DataFrame:
    """V2: by (asset, time, feature) both values where both are there, their differences, and a status.

    OK: equal but for rounding. NOTE: what a burst of trades at a boundary explains, as for features of the shortest scale
    (below 100 %), for ratios of longer ones that keep their sign, and for sums within 5 %. FAIL: all else.
    """
    ten = [c for c in features if c.endswith(f"_{scales[0]}s") or c in ("volume", "rv")]
    signed = [f"{c}_{scales[0]}s" for c in ("OFI", "TCI", "VWAP_dev")]
    ratio = [f"OFI_{scales[1]}s", f"TCI_{scales[1]}s", *(f"Kyle_lambda_{s}s" for s in scales[1:])]
    long = lambda df, name: df.select("asset", "time", *(F.col(c).cast("double").alias(c) for c in features)).unpivot(["asset", "time"], features, "feature", name).where(F.col(name).isNotNull())
    j = long(offline, "offline_value").join(long(live, "live_value"), ["asset", "time", "feature"])
    a, b = F.col("offline_value"), F.col("live_value")
    j = j.withColumn("abs_diff", F.abs(a - b)).withColumn("rel_diff_pct", F.col("abs_diff") / (F.abs(a) + 1e-10) * 100)
    rel, name = F.col("rel_diff_pct"), F.col("feature")
    flip = (F.abs(a) > 0.1) & (F.abs(b) > 0.1) & (F.signum(a) != F.signum(b))
    status = (
        F.when((rel < 1e-4) | (F.col("abs_diff") < 1e-4), "OK")
        .when(name.isin(signed + ratio), F.when(flip, "FAIL sign").otherwise("NOTE noise"))
        .when(name.isin(ten), F.when(rel > 100, "FAIL apart").otherwise("NOTE noise"))
        .when(rel < 5, "NOTE close")
        .otherwise("FAIL apart")
    )
    return j.withColumn("status", status)


def parity_summary(ledger: DataFrame) -> DataFrame:
    """V3."""
    kinds = [F.count_if(F.col("status").startswith(k)).alias(k.lower()) for k in ("OK", "NOTE", "FAIL")]
    return ledger.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.max("abs_diff").alias("max_abs_diff"), F.max("rel_diff_pct").alias("max_rel_diff_pct"), *kinds)
