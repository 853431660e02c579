"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


#: What a sequence of bars belongs to: returns, carried prices and rolling frames start anew with each.
SEGMENT = ("asset", "month")


def with_month(df: DataFrame) -> DataFrame:
    """df with `month`, the first day of the month of `time`, if it has none."""
    return df if "month" in df.columns else df.withColumn("month", F.trunc("time", "month"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rolling(rows: int, *keys: str, order: str = "time"):
    """The last `rows` rows of a key, this one included."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)


def when_full(value: Column, frame, rows: int) -> Column:
    """value once the frame holds `rows` rows, else null."""
    return F.when(F.count(F.lit(1)).over(frame) == rows, value)


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def finite(c: Column | str) -> Column:
    """c, or null where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_corr(x: Column, y: Column, frame) -> Column:
    """Rolling correlation; null where either side doesn't vary (corr itself would divide by zero)."""
    sx, sy = F.stddev_samp(x).over(frame), F.stddev_samp(y).over(frame)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_samp(x, y).over(frame) / (sx * sy))


def band(c: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that c reaches, bounds from high to low."""
    out = F
    for bound, label in steps:
        out = out.when(c >= bound, label)
    return out.otherwise(otherwise)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)
