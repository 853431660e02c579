"""The given tables as the library's own, in Spark and as SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import read

SECONDS = 3600


def all_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a trade, bad prices too."""
    qty = 1.0 + F.col("user_id") % 10
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.col("event_id").alias("id"), F.col("ts").alias("time"), F.col("value").alias("price"), qty.alias("qty"), (F.col("value") * qty).alias("quote_qty"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_trades(spark, sf_dir).where("price > 0")


#: Shares of an asset's bars below which a label ends: 0 up to the first, 2 above the second.
CALM, TENSE = 0.60, 0.85


def cuts(dense: DataFrame) -> DataFrame:
    """asset, calm, tense: percentiles of the bars' volatility, so labels keep their shares at any size of the tables."""
    return dense.groupBy("asset").agg(F.percentile("rv", CALM).alias("calm"), F.percentile("rv", TENSE).alias("tense"))


def labels(dense: DataFrame) -> DataFrame:
    """A fixture of labels: 2 where a bar's volatility is in its asset's top 15 %, 1 in the 25 % below, else 0."""
    cut = dense.join(F.broadcast(cuts(dense)), "asset")  # a row an asset
    return cut.select("asset", "time", "price", F.when(F.col("rv") >= F.col("tense"), 2).when(F.col("rv") > F.col("calm"), 1).otherwise(0).alias("label"))


#: The span of the events is cut into so many windows of whole days; those after the first are folds.
WINDOWS_OF = 3


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window, start, stop: equal parts of the days from the first event to the last."""
    first, last = read(spark, sf_dir, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    days = (last - first).days + 1 if first else 0
    at = [str((first or datetime.date(1970, 1, 1)) + datetime.timedelta(days=k * days // WINDOWS_OF)) for k in range(WINDOWS_OF + 1)]
    rows = spark.createDataFrame([(k, at[k], at[k + 1]) for k in range(WINDOWS_OF)], "window int, a string, z string")
    return rows.select("window", F.col("a").cast("timestamp_ntz").alias("start"), F.col("z").cast("timestamp_ntz").alias("stop"))


SPANS = f"""spans AS (SELECT k AS "window", d + (k * n // {WINDOWS_OF})::INT * INTERVAL 1 DAY AS start, d + ((k + 1) * n // {WINDOWS_OF})::INT * INTERVAL 1 DAY AS stop
  FROM (SELECT min(ts)::DATE AS d, max(ts)::DATE - min(ts)::DATE + 1 AS n FROM events), (SELECT unnest(generate_series(0, {WINDOWS_OF - 1})) AS k))"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


TRADES = """trades AS (SELECT event_type AS asset, event_id AS id, ts AS time, value AS price, 1.0::DOUBLE + user_id % 10 AS qty,
  value * (1.0::DOUBLE + user_id % 10) AS quote_qty, event_id % 2 = 1 AS is_buyer_maker, date_trunc('month', ts)::DATE AS month FROM events WHERE value > 0)"""
EVERY = TRADES.replace(" WHERE value > 0", "")
BARS = (
    TRADES
    + """, steps AS (SELECT *, date_trunc('hour', time) AS bar,
  greatest(-0.5, least(0.5, coalesce(ln(price) - lag(ln(price)) OVER w, 0.0))) AS r, (epoch_us(time) - lag(epoch_us(time)) OVER w)::DOUBLE AS dt
  FROM trades WINDOW w AS (PARTITION BY asset, month ORDER BY time, id)),
bars AS (SELECT asset, month, bar AS time, sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE qty END)::DOUBLE AS v_buy, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0.0 END)::DOUBLE AS v_sell,
  sum(CASE WHEN is_buyer_maker THEN 0 ELSE 1 END)::BIGINT AS n_buy, sum(CASE WHEN is_buyer_maker THEN 1 ELSE 0 END)::BIGINT AS n_sell, sum(qty)::DOUBLE AS volume, sum(quote_qty) AS quote,
  last(price ORDER BY time, id) AS price, sqrt(sum(r * r)) AS rv, sum(abs(r)) AS abs_r, avg(dt) AS mean_dt, stddev_samp(dt) AS std_dt FROM steps GROUP BY asset, month, bar)"""
)
DENSE = (
    BARS
    + """, grid AS (SELECT asset, month, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM bars GROUP BY asset, month),
whole AS (SELECT g.asset, g.month, g.time, coalesce(v_buy, 0) AS v_buy, coalesce(v_sell, 0) AS v_sell, coalesce(n_buy, 0) AS n_buy, coalesce(n_sell, 0) AS n_sell, coalesce(volume, 0) AS volume,
  coalesce(quote, 0) AS quote, last_value(price IGNORE NULLS) OVER (PARTITION BY g.asset, g.month ORDER BY g.time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, coalesce(rv, 0) AS rv,
  coalesce(abs_r, 0) AS abs_r, mean_dt, std_dt FROM grid g LEFT JOIN bars b ON g.asset = b.asset AND g.month = b.month AND g.time = b.time),
dense AS (SELECT * EXCLUDE (far), sum(far) OVER (PARTITION BY asset ORDER BY time) AS seg FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY asset ORDER BY time) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS far FROM whole)),
deltas AS (SELECT *, coalesce(price - lag(price) OVER w, 0.0) AS dp, v_buy - v_sell AS sv FROM dense WINDOW w AS (PARTITION BY asset, month ORDER BY time)),
cut AS (SELECT asset, quantile_cont(rv, 0.60) AS calm, quantile_cont(rv, 0.85) AS tense FROM dense GROUP BY asset),
lab AS (SELECT dense.asset, time, seg, price, (CASE WHEN rv >= tense THEN 2 WHEN rv > calm THEN 1 ELSE 0 END)::BIGINT AS label FROM dense JOIN cut ON dense.asset = cut.asset)"""
)


def _scale(w: int) -> str:
    f, n = f"OVER w{w}", w * SECONDS
    full = lambda x, c: f"round(CASE WHEN count(*) {f} = {w} THEN {x} END, 6) AS {c}_{n}s"
    s = lambda c: f"sum({c}) {f}"
    vwap = f"({s('quote')} / ({s('volume')} + 1e-8))"
    out = [
        full(f"({s('v_buy')} - {s('v_sell')}) / ({s('v_buy')} + {s('v_sell')} + 1e-8)", "OFI"),
        full(f"({s('n_buy')} - {s('n_sell')}) / ({s('n_buy')} + {s('n_sell')} + 1e-8)", "TCI"),
        full(f"({s('n_buy')} + {s('n_sell')}) / {n}", "intensity"),
        full(vwap, "VWAP"),
        full(f"(price - {vwap}) / ({vwap} + 1e-8)", "VWAP_dev"),
        full(f"{s('abs_r')} / ({s('volume')} + 1e-8)", "ILLIQ"),
        full(f"sqrt({s('rv * rv')})", "RV"),
    ]
    if w > 1:
        sp, sv = f"stddev_samp(dp) {f}", f"stddev_samp(sv) {f}"
        out.append(f"round(coalesce(CASE WHEN count(*) {f} = {w} AND {sp} > 1e-12 AND {sv} > 1e-12 THEN covar_samp(dp, sv) {f} / ({sp} * {sv}) * {sp} / ({sv} + 1e-8) END, 0.0), 6) AS Kyle_lambda_{n}s")
    return ", ".join(out)


WINDOWS = "WINDOW " + ", ".join(f"w{w} AS (PARTITION BY asset, month ORDER BY time ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (1, 6, 30))
FEATURES = f"""SELECT asset, month, time, round(price, 6) AS price, volume, round(rv, 6) AS rv, {_scale(1)}, {_scale(6)}, {_scale(30)},
  round(coalesce(std_dt / (mean_dt + 1e-8), 0.0), 6) AS CV_dt_{SECONDS}s FROM deltas {WINDOWS}"""
