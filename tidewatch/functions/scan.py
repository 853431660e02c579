"""Scans over the bars of an asset without a task an asset.

Time is cut into chunks, and windows run within (asset, chunk). What needs the n bars before gets them as copies in the chunks
that they reach; what is carried on without a bound (the last valid value, a run's length) comes from a table of one row a
chunk, whose windows are by asset. Segments end at gaps longer than a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import col

#: Seconds of a chunk: a day holds 8,640 bars of 10 seconds.
CHUNK = 86_400
KEYS = ("asset",)


def _us(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _chunk(us: Column, chunk: int) -> Column:
    return F.floor(us / (chunk * 1_000_000))


def in_reach(df: DataFrame, rows: int, width: float, keys: tuple[str, ...] = KEYS, chunk: int = CHUNK, time: str = "time") -> DataFrame:
    """df with each row also in the later chunks that `rows` bars of `width` seconds reach: _chunk, _own (false for a copy), _seg.

    Within (keys, _chunk, _seg), ordered by time, the rows up to a row of its own chunk are the last `rows` + 1 of its segment,
    or all there are.
    """
    us, reach = _us(time), int(rows * width * 1_000_000)
    x = df.withColumn("_own", _chunk(us, chunk)).withColumn("_chunk", F.explode(F.sequence(F.col("_own"), _chunk(us + reach, chunk))))
    x = x.withColumn("_own", F.col("_own") == F.col("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(time)
    gap = us - F.lag(us).over(w) > width * 1_000_000
    return x.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_seg", F.sum("_gap").over(w)).drop("_gap")


def reach_window(keys: tuple[str, ...] = KEYS, time: str = "time"):
    return Window.partitionBy(*keys, "_chunk", "_seg").orderBy(time)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk", "_seg")


def segment_starts(df: DataFrame, width: float, keys: tuple[str, ...] = KEYS, chunk: int = CHUNK, time: str = "time") -> DataFrame:
    """df with _begins: whether a row is the first of its segment."""
    x = in_reach(df, 1, width, keys, chunk, time)
    return own_rows(x.withColumn("_begins", F.lag(time).over(reach_window(keys, time)).isNull()))


def carried(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = KEYS, chunk: int = CHUNK, time: str = "time") -> DataFrame:
    """df with, for each name, its value's last one that isn't null, of this row and all before it."""
    x = df.withColumn("_chunk", _chunk(_us(time), chunk)).withColumns({f"_v_{n}": v for n, v in values.items()})
    last = x.groupBy(*keys, "_chunk").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(time))).alias(f"_c_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, "_chunk", *(F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values))
    here = Window.partitionBy(*keys, "_chunk").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_v_{n}": F.last(f"_v_{n}", ignorenulls=True).over(here) for n in values}).join(last, [*keys, "_chunk"])
    return x.select(*(c for c in df.columns if c not in values), *(F.coalesce(f"_v_{n}", f"_c_{n}").alias(n) for n in values))


def run_length(df: DataFrame, hit: Column | str, name: str, gap: float | None = None, keys: tuple[str, ...] = KEYS, chunk: int = CHUNK, time: str = "time") -> DataFrame:
    """df with name: how many rows in a row are hits, up to this one (0 where it is none). With gap, a row that comes more than so many seconds after the one before starts anew."""
    us = _us(time)
    x = df.withColumns({"_chunk": _chunk(us, chunk), "_hit": F.coalesce(col(hit), F.lit(False)).cast("long")})
    w = Window.partitionBy(*keys, "_chunk").orderBy(time)
    far = F.coalesce(us - F.lag(us).over(w) > gap * 1_000_000, F.lit(False)) if gap is not None else F.lit(False)
    x = x.withColumn("_new", (far | (F.col("_hit") == 0)).cast("long")).withColumn("_part", F.sum("_new").over(w))
    x = x.withColumn("_n", F.sum("_hit").over(Window.partitionBy(*keys, "_chunk", "_part").orderBy(time)))
    # a chunk hands on the hits since its last break, and those from before it where it has none
    ends = x.groupBy(*keys, "_chunk").agg(F.max("_new").alias("_broken"), F.max_by("_n", time).alias("_tail"), F.min(us).alias("_first"), F.max(us).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    away = F.coalesce(F.col("_first") - F.lag("_last").over(order) > gap * 1_000_000, F.lit(False)) if gap is not None else F.lit(False)
    ends = ends.withColumn("_away", away.cast("long"))
    # a gap before a chunk parts it from those before; a break in it parts those after from what came before the break
    ends = ends.withColumn("_group", F.sum(F.greatest("_broken", "_away")).over(order))
    ends = ends.withColumn("_out", F.sum("_tail").over(Window.partitionBy(*keys, "_group").orderBy("_chunk")))
    ends = ends.select(*keys, "_chunk", F.when(F.col("_away") == 1, 0).otherwise(F.coalesce(F.lag("_out").over(order), F.lit(0))).cast("long").alias("_in"))
    x = x.join(ends, [*keys, "_chunk"])
    return x.select(*df.columns, (F.col("_n") + F.when(F.col("_part") == 0, F.col("_in")).otherwise(0)).alias(name))
