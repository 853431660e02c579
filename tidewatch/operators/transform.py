"""Differencing, stationarity, cleaning and sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SEGMENT, finite, with_month
from ..functions.scan import CHUNK, in_reach


def fracdiff_weights(d: float, least: float = 1e-5) -> list[float]:
    """Weights of the fractional difference, the newest first, while they are not below `least`."""
    w, k = [1.0], 1
    while abs(nxt := -w[-1] * (d - k + 1) / k) >= least:
        w.append(nxt)
        k += 1
    return w


def fracdiff_short(df: DataFrame, column: str, d: float, least: float = 1e-3, strict: bool = False, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """D2 and D3 for short kernels, in columns only; each month of an asset by itself. strict: null unless all values are there; else the first len(w) outputs are 0."""
    columns, df = df.columns, with_month(df)
    w = fracdiff_weights(d, least)
    over = Window.partitionBy(*keys).orderBy("time")
    values = F.collect_list(finite(column) if strict else F.coalesce(finite(column), F.lit(0.0))).over(over.rowsBetween(-(len(w) - 1), 0))
    total = F.aggregate(F.zip_with(F.reverse(values), F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    if strict:
        return df.withColumn(column, F.when(F.size(values) == len(w), total)).select(*columns)
    return df.withColumn(column, F.when(F.row_number().over(over) > len(w), total).otherwise(0.0)).select(*columns)


def fracdiff(df: DataFrame, d_map: dict[str, float], keys: tuple[str, ...] = SEGMENT, least: float = 1e-5, width: float = 10, chunk: int = CHUNK) -> DataFrame:
    """Causal filter of bars on a regular grid (width: seconds of a bar) by key in time order, warm-up zeroed.

    Overlap-save: a group is a chunk of a key's bars and, before it, as many as the longest kernel needs, of the filtered
    columns alone; each is filtered by FFT. Other columns stay where they are and are joined by key and time. A month without
    its own column in df is that of time.
    """
    if not d_map:
        return df
    kernels = {c: np.array(fracdiff_weights(d, least)) for c, d in d_map.items()}
    most = max(map(len, kernels.values()))
    rows = with_month(df).select(*keys, "time", *d_map)
    starts = rows.groupBy(*keys).agg(F.min("time").alias("_start"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    parts = in_reach(rows, most - 1, width, keys, chunk).join(starts, list(keys))
    parts = parts.withColumn("_at", F.round((us("time") - us("_start")) / (width * 1_000_000)).cast("long")).select(*keys, "time", *d_map, "_chunk", "_own", "_at")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time").reset_index(drop=True)
        for c, w in kernels.items():
            x = np.nan_to_num(part[c].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
            n = 1 << int(np.ceil(np.log2(len(x) + len(w))))
            y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(w, n), n)[: len(x)]
            part[c] = np.where(part["_at"] < len(w), 0.0, y)
        return part[part["_own"].to_numpy(bool)][[*keys, "time", *d_map]]

    kinds = dict(rows.dtypes)
    made = parts.groupBy(*keys, "_chunk").applyInPandas(run, ", ".join(f"{c} {'double' if c in d_map else kinds[c]}" for c in (*keys, "time", *d_map)))
    if set(df.columns) <= {*keys, "time", *d_map}:
        return made.select(*df.columns)
    return with_month(df).drop(*d_map).join(made, [*keys, "time"]).select(*df.columns)


# MacKinnon's approximation of the unit-root distribution with a constant, one variable: bounds, and coefficients below and above the middle one.
ADF_LOW, ADF_MIDDLE, ADF_HIGH = -18.83, -1.61, 2.74
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(t: float) -> float:
    """The p-value of a unit-root t-statistic."""
    if t > ADF_HIGH or t < ADF_LOW:
        return float(t > ADF_HIGH)
    z = sum(c * t**k for k, c in enumerate(ADF_SMALL if t <= ADF_MIDDLE else ADF_LARGE))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def adf_test(df: DataFrame, columns: list[str], lags: int | None = None, max_lags: int = 12, keys: tuple[str, ...] = ("asset",), level: float = 0.05, segment: tuple[str, ...] = ()) -> DataFrame:
    """T-statistic and p-value of the unit-root regression with a constant and lagged differences, by key and column.

    lags fixes their number; else the one of 0 to max_lags with the least AIC is taken, all on the rows that have max_lags
    of them. The design's products are summed in one aggregation, so only (max_lags + 3)^2 numbers of a key and column remain.
    Constant columns and those with fewer than 20 finite values have null statistics. stationary: p below `level`.
    segment: further columns within whose values differences are taken; their rows are fitted together.
    """
    most = max_lags if lags is None else lags
    over = Window.partitionBy(*keys, *segment, "column").orderBy("time")
    long = df.select(*keys, *segment, "time", *(finite(c).alias(c) for c in columns)).unpivot([*keys, *segment, "time"], columns, "column", "x").where("x is not null")
    long = long.withColumns({"dx": F.col("x") - F.lag("x").over(over), "level": F.lag("x").over(over)})
    long = long.withColumns({f"d{k}": F.lag("dx", k).over(over) for k in range(1, most + 1)}).dropna()
    names = ["one", "level", *(f"d{k}" for k in range(1, most + 1)), "dx"]
    long = long.withColumn("one", F.lit(1.0))
    sums = long.groupBy(*keys, "column").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))

    def fitted(g: np.ndarray, p: int):
        """AIC and t of the regression on the first p columns."""
        x, n = g[:p, :p], g[0, 0]
        if n <= p or np.linalg.matrix_rank(x) < p:
            return None
        beta = np.linalg.solve(x, g[:p, -1])
        rest = max(g[-1, -1] - beta @ g[:p, -1], 1e-300)
        t = beta[1] / np.sqrt(max(rest / (n - p) * np.linalg.inv(x)[1, 1], 1e-300))
        return n * np.log(rest / n) + 2 * p, t

    def solve(batches):
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                g = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(most + 3)] for i in range(most + 3)], float)
                n = int(g[0, 0])
                found = [(f[0], k, f[1]) for k in range(most + 1) if lags in (None, k) and (f := fitted(g, k + 2))] if n + most + 1 >= 20 else []
                _, k, t = min(found, default=(0, None, None))
                p = None if t is None else adf_p(t)
                out.append((*(r[c] for c in keys), r["column"], n, k, t, p, None if p is None else p < level))
            yield pd.DataFrame(out, columns=[*keys, "column", "n", "lags", "t_stat", "p_value", "stationary"]).astype({"lags": "Int64", "stationary": "boolean"})

    kinds = dict(df.dtypes)
    return sums.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", column string, n long, lags long, t_stat double, p_value double, stationary boolean")


def find_min_d(df: DataFrame, column: str, grid: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), least: float = 1e-3, lags: int | None = None, rows: int = 100) -> DataFrame:
    """The smallest d of the grid whose difference is stationary, else 1.0; all d in one job, from one window of lagged values.

    Each month is differenced by itself and its warm-up left out; an asset's months are tested together. A d that leaves
    `rows` values or fewer isn't considered.
    """
    kernels = [fracdiff_weights(d, least) for d in grid]
    over = Window.partitionBy(*SEGMENT).orderBy("time")
    lagged = F.reverse(F.collect_list(F.coalesce(finite(column), F.lit(0.0))).over(over.rowsBetween(-(max(map(len, kernels)) - 1), 0)))
    x = with_month(df).select(*SEGMENT, "time", lagged.alias("_v"), F.row_number().over(over).alias("_n"))
    dim = F.array(*(F.struct(F.lit(d).alias("d"), F.array(*map(F.lit, w)).alias("w")) for d, w in zip(grid, kernels, strict=True)))
    x = x.select(*SEGMENT, "time", "_v", "_n", F.explode(dim).alias("_k")).where(F.col("_n") > F.size("_k.w"))
    total = F.aggregate(F.zip_with(F.slice("_v", F.lit(1), F.size("_k.w")), "_k.w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    x = x.select(*SEGMENT, "time", F.col("_k.d").alias("d"), total.alias(column))
    enough = x.groupBy("asset", "d").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    found = adf_test(x, [column], lags, keys=("asset", "d"), segment=("month",)).join(enough, ["asset", "d"])
    least_d = found.groupBy("asset").agg(F.min(F.when(F.col("stationary"), F.col("d"))).alias("d"))
    return df.select("asset").distinct().join(least_d, "asset", "left").select("asset", F.coalesce("d", F.lit(1.0)).alias("d"))


def swap_columns(base: DataFrame, alt: DataFrame, columns: list[str]) -> DataFrame:
    """Base with these columns taken from alt, by (asset, time)."""
    joined = base.drop(*columns).join(alt.select("asset", "time", *columns), ["asset", "time"])
    return joined.select(*base.columns)


def nan_to_num(df: DataFrame, columns: list[str]) -> DataFrame:
    """N1."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in columns})


def clean_features(df: DataFrame, columns: list[str], key: str = "asset", top: float = 0.999, approximate: bool = False) -> DataFrame:
    """Infinite to null, median for null, clipped to the top percentile of the absolute value, by key. approximate: percentiles from sketches by month."""
    if approximate:
        return clean_by_sketches(df, feature_sketches(df, columns, key), columns, key, top)
    x = df.withColumns({c: finite(c) for c in columns})
    first = x.groupBy(key).agg(*(F.percentile(c, 0.5).alias(f"m_{c}") for c in columns))
    x = x.join(F.broadcast(first), key)  # a row an asset
    x = x.withColumns({c: F.coalesce(c, f"m_{c}") for c in columns})
    bound = x.groupBy(key).agg(*(F.percentile(F.abs(c), top).alias(f"b_{c}") for c in columns))
    x = x.join(F.broadcast(bound), key)
    return x.withColumns({c: F.greatest(-F.col(f"b_{c}"), F.least(F.col(f"b_{c}"), F.col(c))) for c in columns}).select(*df.columns)


#: Size of a sketch, and the ranks that are asked for; the rank of a percentile is off by about a thousandth at most.
SKETCH, RANKS = 4096, 4000


def feature_sketches(df: DataFrame, columns: list[str], key: str = "asset", size: int = SKETCH) -> DataFrame:
    """By key and month, for each column quantile sketches (KLL) of its finite values and of their absolute values, and how
    many rows have none. Months are sketched once and kept; clean_by_sketches merges them."""
    x = with_month(df).select(key, "month", *(finite(c).alias(c) for c in columns))
    parts = [(f(c), n) for c in columns for f, n in ((lambda c: F.kll_sketch_agg_double(c, size), f"x_{c}"), (lambda c: F.kll_sketch_agg_double(F.abs(c), size), f"a_{c}"), (lambda c: F.count_if(F.col(c).isNull()), f"n_{c}"))]
    return x.groupBy(key, "month").agg(*(f.alias(n) for f, n in parts))


def clean_by_sketches(df: DataFrame, sketches: DataFrame, columns: list[str], key: str = "asset", top: float = 0.999) -> DataFrame:
    """N2 with percentiles of the merged sketches. A value that is filled in counts in the top percentile as the median that it becomes."""
    merged = sketches.groupBy(key).agg(*(f(f"{n}_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("x", F.kll_merge_agg_double), ("a", F.kll_merge_agg_double), ("n", F.sum))))
    bounds = {}
    for c in columns:
        a, filled = F.col(f"a_{c}"), F.col(f"n_{c}").cast("double")
        n = F.kll_sketch_get_n_double(a).cast("double")
        all_ranks = F.when(n > 0, F.kll_sketch_get_quantile_double(a, F.array(*(F.lit(k / RANKS) for k in range(RANKS + 1)))))  # ranks must be constants
        at = lambda rank, q=all_ranks: F.element_at(q, F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank)) * RANKS).cast("int") + 1)
        middle = F.when(n > 0, F.kll_sketch_get_quantile_double(F.col(f"x_{c}"), F.lit(0.5)))
        below, above = at(top * (n + filled) / n), at((top * (n + filled) - filled) / n)
        bounds |= {f"m_{c}": middle, f"b_{c}": F.when(below < F.abs(middle), below).when(above > F.abs(middle), above).otherwise(F.abs(middle))}
    x = df.join(F.broadcast(merged.select(key, *(v.alias(n) for n, v in bounds.items()))), key)  # a row an asset
    clean = {c: F.greatest(-F.col(f"b_{c}"), F.least(F.col(f"b_{c}"), F.coalesce(finite(c), f"m_{c}"))) for c in columns}
    return x.withColumns(clean).select(*df.columns)


def standardize(fit: DataFrame, apply: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the mean and population deviation of fit; a constant column becomes 0."""
    stats = fit.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    x = apply.crossJoin(F.broadcast(stats))  # one row
    return x.withColumns({c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns}).select(*apply.columns)


def class_weights(df: DataFrame, label: str = "label", classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """N / (k n_c) for each class, 1 for one without rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} int")
    joined = dim.join(counts, label, "left").crossJoin(total)
    return joined.select(label, F.coalesce(F.col("total") / (len(classes) * F.col("n")), F.lit(1.0)).alias("weight"))


def weighted_resample(df: DataFrame, weight: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """About n rows with replacement, in proportion to weight: a Poisson number of copies by the MD5 of the key.

    A row that is due more than one copy gets the sum of so many draws at a rate of at most 1 each. A draw is over 19 with a
    chance of 1e-19, and its hash has 40 bits, so the terms below leave nothing out.
    """
    total = df.agg(F.sum(weight).alias("_total"))
    x = df.crossJoin(F.broadcast(total)).withColumn("_l", F.col(weight) * n / F.col("_total"))  # one row
    x = x.withColumn("_m", F.greatest(F.lit(1), F.ceil("_l"))).where("_l > 0").withColumn("_r", F.col("_l") / F.col("_m")).withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m").cast("long"))))
    u = F.conv(F.substring(F.md5(F.concat_ws("/", key, "_d", F.lit(seed)).cast("binary")), 1, 10), 16, 10).cast("long") / float(1 << 40)
    x = x.withColumn("_u", u)
    start = F.struct(F.exp(-F.col("_r")).alias("term"), F.exp(-F.col("_r")).alias("below"), F.lit(0).alias("n"))

    def step(s, k):
        term = s["term"] * F.col("_r") / k
        return F.struct(term.alias("term"), (s["below"] + term).alias("below"), (s["n"] + F.when(F.col("_u") >= s["below"], 1).otherwise(0)).alias("n"))

    x = x.withColumn("_n", F.aggregate(F.sequence(F.lit(1), F.lit(19)), start, step, lambda s: s["n"])).where("_n > 0")
    return x.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*df.columns)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows with the smallest MD5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("/", key, F.lit(seed)).cast("binary")), key).limit(n)


def encode_alphabetical(df: DataFrame, column: str = "asset") -> DataFrame:
    """The place of the value among all in alphabetical order."""
    ranks = df.select(column).distinct()
    ranks = ranks.withColumn(f"{column}_id", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # a row a distinct value
    return df.join(ranks, column)
