"""Trades to bars on a regular grid.

A segment is an asset's month (`month`, made from `time` where it is absent). Returns, gaps and carried prices don't cross
from one segment into the next, and the grid of a segment ends with its last trade, so months without trades cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SEGMENT, clip, with_month


def signed_flow(trades: DataFrame) -> DataFrame:
    """B1: the buyer is the maker in a sell."""
    sell = F.col("is_buyer_maker")
    flow = {"v_buy": F.when(~sell, F.col("qty")).otherwise(0.0), "v_sell": F.when(sell, F.col("qty")).otherwise(0.0), "n_buy": F.when(~sell, 1).otherwise(0), "n_sell": F.when(sell, 1).otherwise(0)}
    return trades.withColumns(flow)


def log_return(trades: DataFrame, most: float = 0.5) -> DataFrame:
    """B2: r within the segment, first 0, clipped. For whole tables bars() does the same without ordering a month in one task."""
    w = Window.partitionBy(*SEGMENT).orderBy("time", "id")
    return with_month(trades).withColumn("r", F.coalesce(clip(F.log("price") - F.lag(F.log("price")).over(w), -most, most), F.lit(0.0)))


def inter_trade_time(trades: DataFrame) -> DataFrame:
    """Microseconds since the segment's trade before."""
    w = Window.partitionBy(*SEGMENT).orderBy("time", "id")
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    return with_month(trades).withColumn("dt", micros - F.lag(micros).over(w))


def bars(trades: DataFrame, width: str = "10 seconds", most: float = 0.5) -> DataFrame:
    """Bars labelled by their start.

    Trades are ordered within a bar only. The return and the gap that cross into a bar come from the bar before, on the
    small table of bars; sums, sums of squares and counts are then completed.
    """
    t = signed_flow(with_month(trades)).withColumns({"bar": F.window("time", width)["start"], "us": F.unix_micros(F.col("time").cast("timestamp")), "lp": F.log("price")})
    w = Window.partitionBy(*SEGMENT, "bar").orderBy("time", "id")
    t = t.withColumns({"r": clip(F.col("lp") - F.lag("lp").over(w), -most, most), "dt": (F.col("us") - F.lag("us").over(w)).cast("double")})
    at = F.struct("time", "id")
    b = t.groupBy(*SEGMENT, "bar").agg(
        *(F.sum(c).alias(c) for c in ("v_buy", "v_sell", "n_buy", "n_sell")),
        F.sum("qty").alias("volume"),
        F.sum("quote_qty").alias("quote"),
        F.max_by("price", at).alias("price"),
        *(F.min_by(c, at).alias(f"{c}0") for c in ("lp", "us")),
        *(F.max_by(c, at).alias(f"{c}1") for c in ("lp", "us")),
        F.coalesce(F.sum(F.col("r") ** 2), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.abs("r")), F.lit(0.0)).alias("abs_r"),
        F.count("dt").alias("n_dt"),
        F.coalesce(F.sum("dt"), F.lit(0.0)).alias("s_dt"),
        F.coalesce(F.sum(F.col("dt") ** 2), F.lit(0.0)).alias("ss_dt"),
    )
    over = Window.partitionBy(*SEGMENT).orderBy("bar")
    r = F.coalesce(clip(F.col("lp0") - F.lag("lp1").over(over), -most, most), F.lit(0.0))
    gap = (F.col("us0") - F.lag("us1").over(over)).cast("double")
    b = b.withColumns({"r_in": r, "gap": gap})
    n = F.col("n_dt") + F.col("gap").isNotNull().cast("int")
    s, ss = F.col("s_dt") + F.coalesce("gap", F.lit(0.0)), F.col("ss_dt") + F.coalesce(F.col("gap") ** 2, F.lit(0.0))
    return b.select(
        *SEGMENT, F.col("bar").alias("time"), "v_buy", "v_sell", "n_buy", "n_sell", "volume", "quote", "price",
        F.sqrt(F.col("rr") + F.col("r_in") ** 2).alias("rv"),
        (F.col("abs_r") + F.abs("r_in")).alias("abs_r"),
        F.when(n > 0, s / n).alias("mean_dt"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1)))).alias("std_dt"),
    )


FLOWS = ("v_buy", "v_sell", "n_buy", "n_sell", "volume", "quote", "rv", "abs_r")


def densify(table: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Every bar between a segment's first and last; flows 0, price carried forward."""
    table = with_month(table)
    ends = table.groupBy(*SEGMENT).agg(F.min("time").alias("a"), F.max("time").alias("z"))
    grid = ends.select(*SEGMENT, F.explode(F.sequence("a", "z", F.expr(f"interval {width}"))).alias("time"))
    w = Window.partitionBy(*SEGMENT).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(table, [*SEGMENT, "time"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in FLOWS} | {"price": F.last("price", ignorenulls=True).over(w)})


def bar_deltas(table: DataFrame) -> DataFrame:
    """B6."""
    w = Window.partitionBy(*SEGMENT).orderBy("time")
    return with_month(table).withColumns({"dp": F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0)), "sv": F.col("v_buy") - F.col("v_sell")})


def resample_mode(labels: DataFrame, width: str = "300 seconds") -> DataFrame:
    """The most frequent label of each bucket, of equally frequent ones the largest."""
    counts = labels.groupBy("asset", F.window("time", width)["start"].alias("time"), "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("asset", "time").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def ohlc(trades: DataFrame, width: str = "1 minute") -> DataFrame:
    """B8."""
    at = F.struct("time", "id")
    return trades.groupBy("asset", F.window("time", width)["start"].alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close")
    )
