"""Registered queries of the stress analytics, each with SQL for the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import read
from ..operators import audit, bars, evaluate, events, features, model, parity, regimes, transform
from ..sources import trades as io
from ..streaming import live
from .views import BARS, CALM, DENSE, EVERY, FEATURES, SECONDS, SPANS, TENSE, TRADES, all_trades, cuts, labels, rounded, trades, windows

WIDTH = f"{SECONDS} seconds"
#: Fixed dimension: periods as half-open ranges, two inside the events' month and one before any event.
EVENTS = [("early", "2023-12-10 00:00:00", "2023-12-12 00:00:00"), ("first", "2024-01-05 00:00:00", "2024-01-07 00:00:00"), ("second", "2024-01-15 00:00:00", "2024-01-18 00:00:00")]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bars(spark, d):
    return bars.bars(trades(spark, d), WIDTH)


def _dense(spark, d):
    return bars.densify(_bars(spark, d), WIDTH)


def _labels(spark, d):
    return labels(_dense(spark, d))


def _features(spark, d):
    return features.feature_table(trades(spark, d), SECONDS)


def _events(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(EVENTS, "name string, onset string, crisis_end string")
    return rows.select("name", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("onset", "crisis_end")))


_EV = "ev AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{z}')" for n, a, z in EVENTS) + ") e(name, onset, crisis_end))"
_RATERS = "raters AS (SELECT doc_id, quality AS y_true, toxic AS y_pred FROM labels)"


@query(f"WITH {DENSE} {FEATURES}")
def f_feature_table(spark, d):
    return _features(spark, d)


@query(f"WITH {BARS} SELECT asset, month, time, v_buy, v_sell, n_buy, n_sell, volume, round(quote, 6) AS quote, price, round(rv, 6) AS rv, round(abs_r, 6) AS abs_r, round(mean_dt, 1) AS mean_dt, round(std_dt, 1) AS std_dt FROM bars")
def b_bars(spark, d):
    return _bars(spark, d).withColumns({c: F.round(c, 1) for c in ("mean_dt", "std_dt")})


@query(f"WITH {DENSE} SELECT asset, month, time, v_buy, v_sell, n_buy, n_sell, volume, round(quote, 6) AS quote, price, round(rv, 6) AS rv, round(abs_r, 6) AS abs_r, round(mean_dt, 1) AS mean_dt, round(std_dt, 1) AS std_dt, round(dp, 6) AS dp, sv FROM deltas")
def b_densify_deltas(spark, d):
    return bars.bar_deltas(_dense(spark, d)).withColumns({c: F.round(c, 1) for c in ("mean_dt", "std_dt")})


@query(f"WITH {TRADES} SELECT asset, id, time, round(greatest(-0.5, least(0.5, coalesce(ln(price) - lag(ln(price)) OVER w, 0.0))), 6) AS r, epoch_us(time) - lag(epoch_us(time)) OVER w AS dt, CASE WHEN is_buyer_maker THEN 0.0 ELSE qty END AS v_buy FROM trades WINDOW w AS (PARTITION BY asset, month ORDER BY time, id)")
def b_tick_columns(spark, d):
    t = bars.inter_trade_time(bars.log_return(bars.signed_flow(trades(spark, d))))
    return t.select("asset", "id", "time", "r", "dt", "v_buy")


@query(f"WITH {TRADES} SELECT asset, date_trunc('hour', time) AS bar, first(price ORDER BY time, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY time, id) AS close FROM trades GROUP BY 1, 2")
def b_ohlc(spark, d):
    return bars.ohlc(trades(spark, d), WIDTH)


@query(f"""WITH {DENSE}, c AS (SELECT asset, time_bucket(INTERVAL 6 HOUR, time) AS t6, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT asset, t6 AS time, arg_max(label, n * 10 + label) AS label FROM c GROUP BY asset, t6""")
def b_resample_mode(spark, d):
    return bars.resample_mode(_labels(spark, d), "6 hours")


_F = f"f AS ({FEATURES})"


#: Which asset may lead which, as the operator's plan has it: one leads two, and those each other.
_PAIRS = (("click", "view"), ("click", "purchase"), ("view", "purchase"))


def _corr(x: str, y: str, w: int) -> str:
    sx, sy = f"stddev_samp({x}) OVER w{w}", f"stddev_samp({y}) OVER w{w}"
    return f"round(coalesce(CASE WHEN count({x} + {y}) OVER w{w} = {w} AND {sx} > 1e-12 AND {sy} > 1e-12 THEN covar_samp({x}, {y}) OVER w{w} / ({sx} * {sy}) END, 0.0), 4)"


@query(f"""WITH {DENSE}, {_F}, pairs AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)}) v(lead, target)),
j AS (SELECT pairs.lead, x.asset, x.month, x.time, x.OFI_21600s AS a, y.OFI_21600s AS b, x.OFI_108000s AS c, y.OFI_108000s AS e FROM pairs JOIN f x ON x.asset = target LEFT JOIN f y ON y.asset = pairs.lead AND x.time = y.time),
k AS (SELECT *, lag(b) OVER (PARTITION BY lead, asset, month ORDER BY time) AS b1 FROM j)
SELECT lead, asset, time, {_corr("a", "b", 6)} AS same_bar, {_corr("c", "e", 30)} AS long_bar, {_corr("a", "b1", 6)} AS lead_lag
FROM k WINDOW w6 AS (PARTITION BY lead, asset, month ORDER BY time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY lead, asset, month ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def f_contagion(spark, d):
    f = rounded(_features(spark, d))
    found = features.contagion_plan(f, _PAIRS, short=f"OFI_{6 * SECONDS}s", long=f"OFI_{30 * SECONDS}s")
    out = None
    for lead, target in _PAIRS:
        columns = (("OFI_corr_60s", "same_bar"), ("OFI_corr_300s", "long_bar"), ("Lead_Lag_60s", "lead_lag"))
        one = found[target].select(F.lit(lead).alias("lead"), "asset", "time", *(F.round(f"{a}_{lead}", 4).alias(b) for a, b in columns))
        out = one if out is None else out.unionByName(one)
    return out


SCALES = tuple(k * SECONDS for k in features.SCALES)


def _live_sql() -> str:
    """From anchors a (asset, time): live (asset, time, n_trades and all live features, not rounded)."""
    bar, span = SCALES[0], SCALES[-1] + SCALES[0]
    kinds = {"v_buy": "CASE WHEN is_buyer_maker THEN 0.0 ELSE qty END", "v_sell": "CASE WHEN is_buyer_maker THEN qty ELSE 0.0 END", "n_buy": "(NOT is_buyer_maker)::INT", "n_sell": "is_buyer_maker::INT", "volume": "qty", "quote": "quote_qty", "abs_r": "abs(r)", "rr": "r * r"}
    inside = {x: f"us >= z - {x * 1_000_000}" for x in SCALES}
    sums = [f"(CASE WHEN count(*) FILTER ({inside[x]}) >= 2 THEN sum({e}) FILTER ({inside[x]}) ELSE sum({e}) END)::DOUBLE AS {c}_{x}" for x in SCALES for c, e in kinds.items()]
    out = []
    for x in SCALES:
        vwap = f"(quote_{x} / (volume_{x} + 1e-8))"
        out += [
            f"(v_buy_{x} - v_sell_{x}) / (v_buy_{x} + v_sell_{x} + 1e-8) AS OFI_{x}s", f"(n_buy_{x} - n_sell_{x}) / (n_buy_{x} + n_sell_{x} + 1e-8) AS TCI_{x}s", f"(n_buy_{x} + n_sell_{x}) / {x} AS intensity_{x}s",
            f"{vwap} AS VWAP_{x}s", f"(price - {vwap}) / ({vwap} + 1e-8) AS VWAP_dev_{x}s", f"abs_r_{x} / (volume_{x} + 1e-8) AS ILLIQ_{x}s", f"sqrt(rr_{x}) AS RV_{x}s",
        ]
    lambdas = []
    for x in SCALES[1:]:
        late = f"FILTER (k >= {(span - x) // bar})"
        sp, ss = f"stddev_samp(dp) {late}", f"stddev_samp(sv) {late}"
        lambdas.append(f"coalesce(CASE WHEN {sp} > 1e-12 AND {ss} > 1e-12 THEN covar_samp(dp, sv) {late} / ({sp} * {ss}) * {sp} / ({ss} + 1e-8) END, 0.0) AS Kyle_lambda_{x}s")
    near = f"FILTER ({inside[bar]})"
    return f"""ret AS (SELECT *, epoch_us(time) AS us, greatest(-0.5, least(0.5, coalesce(ln(price) - lag(ln(price)) OVER (PARTITION BY asset, month ORDER BY time, id), 0.0))) AS r FROM trades),
    j AS (SELECT a.asset, a.time, epoch_us(a.time) AS z, us, id, price, qty, quote_qty, is_buyer_maker, r, (us - lag(us) OVER (PARTITION BY a.asset, a.time ORDER BY us, id))::DOUBLE AS gap FROM a JOIN ret ON ret.asset = a.asset AND us <= epoch_us(a.time) AND us > epoch_us(a.time) - {span * 1_000_000}),
    sums AS (SELECT asset, time, count(*) AS n_trades, last(price ORDER BY us, id) AS price, avg(gap) {near} AS mean_dt, stddev_samp(gap) {near} AS std_dt, {", ".join(sums)} FROM j GROUP BY asset, time),
    flow AS (SELECT asset, time, (us - (z - {span * 1_000_000}) - 1) // {bar * 1_000_000} AS k, sum({kinds["v_buy"]} - {kinds["v_sell"]})::DOUBLE AS sv, first(price ORDER BY us, id) AS first, last(price ORDER BY us, id) AS last FROM j GROUP BY ALL),
    g AS (SELECT asset, time, unnest(generate_series(0, {span // bar - 1})) AS k FROM sums),
    carried AS (SELECT g.asset, g.time, g.k, coalesce(sv, 0.0) AS sv, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY g.asset, g.time ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(first IGNORE NULLS) OVER (PARTITION BY g.asset, g.time ORDER BY g.k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p
      FROM g LEFT JOIN flow ON g.asset = flow.asset AND g.time = flow.time AND g.k = flow.k),
    steps_k AS (SELECT *, p - lag(p) OVER (PARTITION BY asset, time ORDER BY k) AS dp FROM carried),
    kyle AS (SELECT asset, time, {", ".join(lambdas)} FROM steps_k GROUP BY asset, time),
    live AS (SELECT s.asset, s.time, n_trades, price, volume_{bar} AS volume, sqrt(rr_{bar}) AS rv, {", ".join(out)}, {", ".join(f"Kyle_lambda_{x}s" for x in SCALES[1:])}, coalesce(std_dt / (mean_dt + 1e-8), 0.0) AS CV_dt_{bar}s FROM sums s JOIN kyle USING (asset, time))"""


LIVE = _live_sql()
LIVE_NAMES = features.live_names(SCALES)


@query(f"""WITH {TRADES}, a AS (SELECT asset, max(time) AS time FROM trades GROUP BY asset, date_trunc('day', time)), {LIVE}
SELECT asset, time, n_trades, {", ".join(f"round({c}, 6) AS {c}" for c in [*LIVE_NAMES, f"CV_dt_{SECONDS}s"])} FROM live""")
def f_features_at(spark, d):
    t = trades(spark, d)
    return features.features_at(t, parity.snap_anchor(t, "1 day").select("asset", F.col("anchor").alias("time")), SCALES)


@query(f"""WITH {TRADES}, a AS (SELECT asset, max(time) AS anchor FROM trades GROUP BY asset), g AS (SELECT asset, anchor, unnest(generate_series(0, 30)) AS k FROM a),
s AS (SELECT a.asset, anchor, ((epoch_us(time) - (epoch_us(anchor) - 31 * 3600000000) - 1) // 3600000000) AS k, sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE qty END)::DOUBLE AS b, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0.0 END)::DOUBLE AS s, last(price ORDER BY time, id) AS p
FROM a JOIN trades t ON a.asset = t.asset AND t.time > anchor - INTERVAL 31 HOUR AND t.time <= anchor GROUP BY ALL)
SELECT g.asset, g.anchor, g.k, coalesce(b, 0) AS v_buy, coalesce(s, 0) AS v_sell, last_value(p IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM g LEFT JOIN s ON g.asset = s.asset AND g.k = s.k""")
def f_anchored_bars(spark, d):
    t = trades(spark, d)
    return features.anchored_bars(t, t.groupBy("asset").agg(F.max("time").alias("time")), 31, SECONDS)


@query(f"""WITH {EVERY} SELECT asset, count(DISTINCT time::DATE) AS days, count(*) AS trades, count(*) - count(DISTINCT id) AS duplicates, count(*) FILTER (price IS NULL OR price <= 0) AS bad_price, count(*) FILTER (price > 1e7) AS huge_price,
count(*) FILTER (qty IS NULL OR qty <= 0) AS bad_qty, count(*) FILTER (id IS NULL OR time IS NULL) AS null_keys, min(time) AS first_time, max(time) AS last_time FROM trades GROUP BY asset""")
def q_trade_summary(spark, d):
    return audit.trade_summary(all_trades(spark, d))


@query(f"WITH {EVERY} SELECT asset, time::DATE AS day, count(*) AS trades FROM trades GROUP BY 1, 2 HAVING count(*) < 60")
def q_low_count_days(spark, d):
    return audit.low_count_days(all_trades(spark, d), 60)


@query(f"""WITH {EVERY}, d AS (SELECT DISTINCT asset, time::DATE AS day FROM trades), m AS (SELECT DISTINCT asset, date_trunc('month', day)::DATE AS m FROM d),
c AS (SELECT asset, unnest(generate_series(m, last_day(m), INTERVAL 1 DAY))::DATE AS day FROM m) SELECT c.asset, c.day FROM c ANTI JOIN d ON c.asset = d.asset AND c.day = d.day""")
def q_missing_days(spark, d):
    return audit.missing_days(all_trades(spark, d))


_MONTHS = """l AS (SELECT o_orderpriority AS asset, strftime(max(o_orderdate) - INTERVAL 60 MONTH, '%Y-%m') AS listed FROM orders GROUP BY 1),
e AS (SELECT asset, m AS month FROM l, (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1997-06-01', INTERVAL 1 MONTH))::DATE AS m UNION ALL SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE) WHERE strftime(m, '%Y-%m') >= listed)"""


def _expected(spark, d):
    listed = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset")).agg(F.date_format(F.max("o_orderdate") - F.expr("interval 60 months"), "yyyy-MM").alias("listed"))
    return audit.expected_months(listed, [("1995-01", "1997-06"), ("2001-01", "2001-12")])


@query(f"WITH {_MONTHS} SELECT asset, month FROM e")
def q_expected_months(spark, d):
    return _expected(spark, d)


@query(f"WITH {_MONTHS}, h AS (SELECT o_orderpriority AS asset, date_trunc('month', o_orderdate)::DATE AS month, count(*) * 100 AS bytes FROM orders GROUP BY 1, 2) SELECT asset, month FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.asset = e.asset AND h.month = e.month AND bytes >= 400)")
def q_missing_partitions(spark, d):
    present = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.trunc("o_orderdate", "month").alias("month")).agg((F.count(F.lit(1)) * 100).alias("bytes"))
    return audit.missing_partitions(_expected(spark, d), present, 400)


@query(f"WITH {EVERY}, i AS (SELECT asset, time::DATE AS day FROM trades GROUP BY 1, 2 HAVING count(*) < 60) SELECT count(*) AS issues, CASE WHEN count(*) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, greatest(0, 100 - 10 * count(*)) AS score FROM i")
def q_quality_score(spark, d):
    return audit.quality_score(audit.low_count_days(all_trades(spark, d), 60))


#: Sources as a monthly file and two later ones that overlap what was there before by so many days.
_OVER = 2
_STITCH = f"""WITH {TRADES}, {SPANS}, s AS (SELECT t.*, "window" AS source FROM trades t JOIN spans ON time >= start - ("window" > 0)::INT * INTERVAL {_OVER} DAY AND time < stop),
e AS (SELECT asset, source, max(time) AS last FROM s GROUP BY 1, 2), b AS (SELECT *, max(last) OVER (PARTITION BY asset ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM e)"""


def _sources(spark, d):
    rows = windows(spark, d).select(F.col("window").alias("source"), F.when(F.col("window") > 0, F.col("start") - F.expr(f"interval {_OVER} days")).otherwise(F.col("start")).alias("a"), F.col("stop").alias("z"))
    return trades(spark, d).join(F.broadcast(rows), (F.col("time") >= F.col("a")) & (F.col("time") < F.col("z"))).drop("a", "z")  # three sources


@query(f"{_STITCH} SELECT s.asset, s.id, s.source::BIGINT AS source FROM s JOIN b ON s.asset = b.asset AND s.source = b.source WHERE after IS NULL OR time > after")
def i_stitch_sources(spark, d):
    return io.stitch_sources(_sources(spark, d)).select("asset", "id", "source")


@query(f"{_STITCH} SELECT asset, id, min(source)::BIGINT AS source FROM s GROUP BY 1, 2")
def i_stitch_by_id(spark, d):
    return io.stitch_sources(_sources(spark, d), by_id=True).select("asset", "id", "source")


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_tax AS tax FROM lineitem WHERE (l_shipdate >= DATE '1993-02-01' AND l_shipdate < DATE '1993-06-01') OR (l_shipdate >= DATE '1996-11-01' AND l_shipdate < DATE '1997-02-01')")
def i_scan_features(spark, d):
    x = read(spark, d, "lineitem").withColumnsRenamed({"l_shipdate": "time", "l_orderkey": "k", "l_linenumber": "n", "l_tax": "tax"})
    return io.scan_features(x, [("1993-02", "1993-05"), ("1996-11", "1997-01")], ["k", "n", "tax"])


@query(f"WITH {TRADES} SELECT asset, id, price FROM trades WHERE asset = 'view' AND time > TIMESTAMP '2024-01-03' AND time <= TIMESTAMP '2024-01-09'")
def i_scan_trades_window(spark, d):
    import datetime as dt

    return io.scan_trades_window(trades(spark, d), "view", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9)).select("asset", "id", "price")


@query("WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT l_orderkey AS k, l_extendedprice AS v FROM lineitem) SELECT k, v FROM a UNION ALL SELECT k, v FROM b")
def i_union_common_columns(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    b = read(spark, d, "lineitem").select("l_tax", F.col("l_extendedprice").alias("v"), F.col("l_orderkey").alias("k"))
    return io.union_common_columns(a, b)


@query(f"WITH {TRADES} SELECT asset, id, CASE asset WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END::BIGINT AS asset_id FROM trades")
def i_pool_assets(spark, d):
    return io.pool_assets(trades(spark, d), ["view", "click", "purchase"]).select("asset", "id", "asset_id")


@query("""WITH s AS (SELECT l_returnflag AS asset, l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount = 0 OR l_tax = 0 OR l_quantity < 3 THEN NULL ELSE (l_tax - 0.04) * l_extendedprice / l_discount * 1.4142135623730951 END AS x FROM lineitem),
f AS (SELECT asset, quantile_cont(x, 0.5) AS mid FROM s GROUP BY asset), t AS (SELECT s.asset, k, n, coalesce(x, mid) AS x FROM s JOIN f ON s.asset = f.asset), m AS (SELECT asset, quantile_cont(abs(x), 0.999) AS b FROM t GROUP BY asset)
SELECT t.asset, k, n::BIGINT AS n, round(greatest(-b, least(b, x)), 4) AS x FROM t JOIN m ON t.asset = m.asset""")
def n_clean_features(spark, d):
    """A ratio that is infinite where its divisor is 0, NaN at other rows and null at others yet."""
    x = F.when(F.col("l_discount") == 0, float("-inf")).when(F.col("l_tax") == 0, float("nan")).when(F.col("l_quantity") < 3, None).otherwise((F.col("l_tax") - 0.04) * F.col("l_extendedprice") / F.when(F.col("l_discount") != 0, F.col("l_discount")) * 1.4142135623730951)  # no value is half of a last decimal
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("asset"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x"))
    return transform.clean_features(rows, ["x"]).withColumn("x", F.round("x", 4))


@query("WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round((l_quantity - m) / s, 6) AS q FROM lineitem, f WHERE l_orderkey % 2 = 1")
def n_standardize(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return transform.standardize(x.where("k % 2 = 0"), x.where("k % 2 = 1"), ["q"])


@query(f"WITH {DENSE}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label), k AS (SELECT unnest([0, 1, 2])::BIGINT AS label) SELECT k.label, round(coalesce((SELECT count(*) FROM lab) / (3.0 * n), 1.0), 6) AS weight FROM k LEFT JOIN c ON k.label = c.label")
def n_class_weights(spark, d):
    return transform.class_weights(_labels(spark, d))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round(CASE WHEN l_tax = 0 OR l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END, 6) AS x FROM lineitem")
def n_nan_to_num(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount"))).alias("x"))
    return transform.nan_to_num(x, ["x"])


@query("WITH a AS (SELECT DISTINCT event_type AS asset FROM events), r AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS asset_id FROM a) SELECT event_id, r.asset, asset_id FROM events JOIN r ON event_type = r.asset")
def n_encode_alphabetical(spark, d):
    return transform.encode_alphabetical(read(spark, d, "events").select("event_id", F.col("event_type").alias("asset"))).select("event_id", "asset", "asset_id")


_W = transform.fracdiff_weights(0.4, 1e-2)
_SUM = " + ".join(f"{w!r} * coalesce(lag(price, {k}) OVER w, 0.0)" if k else "price" for k, w in enumerate(_W))


@query(f"WITH {DENSE} SELECT asset, time, round(CASE WHEN row_number() OVER w > {len(_W)} THEN {_SUM} ELSE 0.0 END, 6) AS price FROM dense WINDOW w AS (PARTITION BY asset, month ORDER BY time)")
def d_fracdiff_short(spark, d):
    return transform.fracdiff_short(_dense(spark, d).select("asset", "time", "price"), "price", 0.4, 1e-2)


@query(f"WITH {DENSE} SELECT asset, time, round(CASE WHEN row_number() OVER w >= {len(_W)} THEN {_SUM} END, 6) AS price FROM dense WINDOW w AS (PARTITION BY asset, month ORDER BY time)")
def d_fracdiff_strict(spark, d):
    return transform.fracdiff_short(_dense(spark, d).select("asset", "time", "price"), "price", 0.4, 1e-2, strict=True)


_LONG = transform.fracdiff_weights(0.3, 1e-3)
_LONG_SUM = " + ".join(f"{w!r} * coalesce(lag(price, {k}) OVER w, 0.0)" if k else "price" for k, w in enumerate(_LONG))


@query(f"WITH {DENSE} SELECT asset, strftime(time, '%Y-%m') AS month, time, round(CASE WHEN row_number() OVER w > {len(_LONG)} THEN {_LONG_SUM} ELSE 0.0 END, 6) AS price FROM dense WINDOW w AS (PARTITION BY asset, dense.month ORDER BY time)")
def d_fracdiff_long(spark, d):
    x = _dense(spark, d).select("asset", F.date_format("time", "yyyy-MM").alias("month"), "time", "price")
    return transform.fracdiff(x, {"price": 0.3}, least=1e-3, width=SECONDS)


@query()
def d_adf_test(spark, d):
    return transform.adf_test(_dense(spark, d).select("asset", "time", "price", "rv"), ["price", "rv"], 2)


@query(f"WITH {DENSE}, b AS (SELECT asset, time, price FROM dense), a AS (SELECT asset, time, price * 2 AS price FROM dense) SELECT b.asset, b.time, round(a.price, 6) AS price FROM b JOIN a ON a.asset = b.asset AND a.time = b.time")
def d_swap_columns(spark, d):
    b = _dense(spark, d).select("asset", "time", "price")
    return transform.swap_columns(b, b.withColumn("price", F.col("price") * 2), ["price"])


@query(f"WITH {DENSE} SELECT asset, count(*) AS n, " + ", ".join(f"round(avg((label = {c})::INT) * 100, 6) AS pct_{c}" for c in (0, 1, 2)) + " FROM lab GROUP BY asset")
def l_label_distribution(spark, d):
    return regimes.label_distribution(_labels(spark, d), "asset")


@query(f"WITH {DENSE}, {_EV} SELECT name, asset, count(*) AS n, " + ", ".join(f"round(avg((label = {c})::INT) * 100, 6) AS pct_{c}" for c in (0, 1, 2)) + " FROM lab JOIN ev ON time >= onset AND time < crisis_end GROUP BY name, asset")
def l_event_label_rates(spark, d):
    return regimes.event_label_rates(_labels(spark, d), _events(spark).select("name", F.col("onset").alias("start"), F.col("crisis_end").alias("stop")))


@query(f"""WITH {DENSE}, p AS (SELECT asset, label AS from_label, lead(label) OVER (PARTITION BY asset, seg ORDER BY time) AS to_label FROM lab), c AS (SELECT asset, from_label, to_label, count(*) AS n FROM p WHERE to_label IS NOT NULL GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY asset, from_label), 6) AS p FROM c""")
def l_transition_matrix(spark, d):
    return regimes.transition_matrix(_labels(spark, d), SECONDS)


@query(f"""WITH {DENSE}, o AS (SELECT asset, time, (CASE WHEN abs_r > 2.0 THEN 2 WHEN abs_r > 1.0 THEN 1 ELSE 0 END) AS y FROM dense), j AS (SELECT asset, label AS x, y FROM lab JOIN o USING (asset, time))
SELECT asset, count(*) AS n, round(avg((x = y)::INT) * 100, 6) AS agree, round(avg((x = y)::INT) FILTER (x = 0) * 100, 6) AS agree_0, round(avg((x = y)::INT) FILTER (x = 1) * 100, 6) AS agree_1, round(avg((x = y)::INT) FILTER (x = 2) * 100, 6) AS agree_2,
round(avg((x = 2)::INT) * 100, 6) AS stress_a, round(avg((y = 2)::INT) * 100, 6) AS stress_b FROM j GROUP BY asset""")
def l_label_agreement(spark, d):
    x = _dense(spark, d)
    other = x.select("asset", "time", F.when(F.col("abs_r") > 2.0, 2).when(F.col("abs_r") > 1.0, 1).otherwise(0).alias("label"))
    return regimes.label_agreement(labels(x), other)


@query(f"""WITH {DENSE}, {SPANS}, j AS (SELECT lab.asset, lab.time, "window" AS win FROM lab JOIN spans ON time >= start AND time < stop)
SELECT asset, time, win::BIGINT AS "window", f.fold, CASE WHEN win = f.fold THEN 'test' ELSE 'train' END AS role FROM j, (SELECT unnest([1, 2])::BIGINT AS fold) f WHERE win <= f.fold""")
def m_walk_forward(spark, d):
    return model.walk_forward(_labels(spark, d), windows(spark, d), [1, 2]).select("asset", "time", "window", "fold", "role")


@query(f"WITH {DENSE}, {_F} SELECT f.asset, f.time, OFI_{6 * SECONDS}s AS OFI, RV_{6 * SECONDS}s AS RV, label FROM f JOIN lab ON f.asset = lab.asset AND f.time = lab.time")
def m_feature_label_join(spark, d):
    x = _features(spark, d).select("asset", "time", F.col(f"OFI_{6 * SECONDS}s").alias("OFI"), F.col(f"RV_{6 * SECONDS}s").alias("RV"))
    return model.feature_label_join(x, _labels(spark, d).drop("price"))


@query(f"WITH {DENSE} SELECT asset, time, label, round(list_sum(seq), 6) AS total FROM (SELECT asset, time, label, list(price) OVER (PARTITION BY asset, seg ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS seq FROM lab) WHERE len(seq) = 60")
def m_sequences(spark, d):
    s = model.sequences(_labels(spark, d), ["price"], width=SECONDS)
    return s.select("asset", "time", "label", F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, b: a + b).alias("total"))


_AT = [(i, j) for i in range(4) for j in range(4)]


@query(f"""WITH {DENSE}, s AS (SELECT asset, time, list(price) OVER (PARTITION BY asset, seg ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS q FROM lab), m AS (SELECT asset, time, q, list_min(q) AS lo, CASE WHEN list_max(q) = list_min(q) THEN 1.0 ELSE list_max(q) - list_min(q) END AS span FROM s WHERE len(q) = 4),
e AS (SELECT asset, time, list_transform(q, lambda v: 2 * (v - lo) / span - 1) AS x FROM m)
SELECT asset, time, {", ".join(f"round(x[{i + 1}] * x[{j + 1}] - sqrt(greatest(0, 1 - x[{i + 1}] * x[{i + 1}])) * sqrt(greatest(0, 1 - x[{j + 1}] * x[{j + 1}])), 5) AS g{i}{j}" for i, j in _AT)} FROM e""")
def m_gasf(spark, d):
    s = model.sequences(_labels(spark, d), ["price"], 4, width=SECONDS).withColumn("g", model.gasf(F.flatten("seq")))
    return s.select("asset", "time", *(F.round(F.col("g")[i][j], 5).alias(f"g{i}{j}") for i, j in _AT))


@query(f"WITH {_RATERS} SELECT round(avg((y_true = y_pred)::INT), 6) AS fidelity FROM raters")
def m_surrogate_fidelity(spark, d):
    return model.surrogate_fidelity(read(spark, d, "labels"), "quality", "toxic")


def _raters(spark, d):
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


_CLASS = """SELECT c, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (SELECT y_true AS c, (y_true = y_pred)::INT AS tp, 1 AS s, 0 AS p FROM raters UNION ALL SELECT y_pred, 0, 0, 1 FROM raters) GROUP BY c"""


@query(f"""WITH {_RATERS}, s AS ({_CLASS}), m AS (SELECT c, tp, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM s), k AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m)
SELECT c::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM k UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM k
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM k UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM k""")
def a_classification_report(spark, d):
    return evaluate.classification_report(_raters(spark, d))


@query(f"WITH {_RATERS} SELECT y_true::BIGINT AS y_true, count(*) FILTER (y_pred = 0) AS c0, count(*) FILTER (y_pred = 1) AS c1 FROM raters GROUP BY y_true")
def a_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_raters(spark, d), [0, 1]).withColumnsRenamed({"0": "c0", "1": "c1"})


@query("""WITH s AS (SELECT l_returnflag AS k, l_quantity AS score, (l_discount > 0.05)::INT AS y FROM lineitem), p AS (SELECT k, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1, 2),
r AS (SELECT k, score, sum(p) OVER w / sum(p) OVER (PARTITION BY k) AS t, sum(n) OVER w / sum(n) OVER (PARTITION BY k) AS f FROM p WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
l AS (SELECT k, t, f, coalesce(lag(t) OVER w, 0) AS t0, coalesce(lag(f) OVER w, 0) AS f0 FROM r WINDOW w AS (PARTITION BY k ORDER BY score DESC)) SELECT k, round(sum((f - f0) * (t + t0) / 2), 6) AS auc FROM l GROUP BY k""")
def a_auc(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("score"), (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return evaluate.auc(s, "k")


@query(f"WITH {DENSE}, p AS (SELECT asset, time, label AS y_true, lag(label) OVER (PARTITION BY asset, seg ORDER BY time) AS y_pred FROM lab) SELECT asset, time, y_true, y_pred FROM p WHERE y_pred IS NOT NULL")
def a_persistence_baseline(spark, d):
    return evaluate.persistence_baseline(_labels(spark, d), SECONDS)


@query(f"WITH {DENSE}, c AS (SELECT asset, label, count(*) AS n FROM lab GROUP BY 1, 2), t AS (SELECT asset, arg_max(label, n * 10 - label) AS y_pred FROM c GROUP BY asset) SELECT lab.asset, time, label AS y_true, y_pred FROM lab JOIN t ON lab.asset = t.asset")
def a_majority_baseline(spark, d):
    return evaluate.majority_baseline(_labels(spark, d))


@query(f"WITH {DENSE}, c AS (SELECT asset, label, count(*) AS n FROM lab GROUP BY 1, 2) SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY asset), 6) AS pct FROM c")
def a_class_prevalence(spark, d):
    return evaluate.class_prevalence(_labels(spark, d), "asset")


def _metrics(spark, d):
    """Metric rows from lineitem: discounts by (mode, model, fold, seed, condition)."""
    x = read(spark, d, "lineitem")
    return x.select(F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("fold"), (F.col("l_suppkey") % 5).alias("seed"), F.when(F.col("l_orderkey") % 2 == 0, "control").otherwise("treatment").alias("condition"), (F.col("l_discount") * 10).alias("f1"))


_MET = "met AS (SELECT l_linestatus AS mode, l_returnflag AS model, l_linenumber % 4 + 1 AS fold, l_suppkey % 5 AS seed, CASE WHEN l_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS condition, l_discount * 10 AS f1 FROM lineitem)"


@query(f"WITH {_MET} SELECT mode, model, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, count(*) AS n FROM met GROUP BY 1, 2")
def a_stability(spark, d):
    return evaluate.stability(_metrics(spark, d), "mode", "model")


@query(f"WITH {_MET} SELECT mode, model, " + ", ".join(f"round(avg(f1) FILTER (fold = {k}), 6) AS fold_{k}" for k in (1, 2, 3, 4)) + " FROM met GROUP BY 1, 2")
def a_fold_progression(spark, d):
    return evaluate.fold_progression(_metrics(spark, d), [1, 2, 3, 4])


@query(f"WITH {_MET}, s AS (SELECT mode, model, seed, avg(f1) AS f1 FROM met WHERE fold = 4 GROUP BY ALL) SELECT mode, model, round(min(f1), 6) AS lowest, round(max(f1), 6) AS highest, round(max(f1) - min(f1), 6) AS range FROM s GROUP BY 1, 2")
def a_seed_range(spark, d):
    s = _metrics(spark, d).groupBy("mode", "model", "seed", "fold").agg(F.avg("f1").alias("f1"))
    return evaluate.seed_range(s, 4)


@query(f"WITH {_MET}, m AS (SELECT mode, model, avg(f1) AS mean FROM met GROUP BY 1, 2) SELECT mode, model, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY mode ORDER BY mean DESC, model) = 1")
def a_best_model(spark, d):
    return evaluate.best_model(_metrics(spark, d), "mode")


@query(f"WITH {_MET} SELECT mode AS asset, model, round(avg(f1), 6) AS mean, count(DISTINCT fold) AS folds FROM met GROUP BY 1, 2")
def a_summary_by_asset(spark, d):
    return evaluate.summary_by_asset(_metrics(spark, d).withColumnRenamed("mode", "asset"))


_ABL = "abl AS (SELECT mode, model, avg(f1) FILTER (condition = 'control') AS control, avg(f1) FILTER (condition = 'treatment') AS treatment FROM met GROUP BY 1, 2), cmp AS (SELECT *, treatment - control AS delta, CASE WHEN treatment - control > 0.001 THEN 'treatment' WHEN treatment - control < -0.001 THEN 'control' ELSE 'tie' END AS winner FROM abl)"


@query(f"WITH {_MET}, {_ABL} SELECT mode, model, round(control, 6) AS control, round(treatment, 6) AS treatment, round(delta, 6) AS delta, winner FROM cmp")
def a_ablation_compare(spark, d):
    return evaluate.ablation_compare(_metrics(spark, d), "control", "treatment", "mode", "model")


@query(f"WITH {_MET}, {_ABL}, v AS (SELECT count(*) FILTER (winner = 'treatment') AS wins, count(*) FILTER (winner = 'control') AS losses, count(*) FILTER (winner = 'tie') AS ties FROM cmp) SELECT *, CASE WHEN wins > losses THEN 'treatment' WHEN wins < losses THEN 'control' ELSE 'tie' END AS verdict FROM v")
def a_ablation_verdict(spark, d):
    return evaluate.ablation_verdict(evaluate.ablation_compare(_metrics(spark, d), "control", "treatment", "mode", "model"))


@query(f"WITH {_MET} SELECT a.mode, a.model, round(a.v, 6) AS model_value, round(b.v, 6) AS baseline_value, round(a.v - b.v, 6) AS lift FROM (SELECT mode, model, avg(f1) AS v FROM met WHERE condition = 'treatment' GROUP BY 1, 2) a JOIN (SELECT mode, model, avg(f1) AS v FROM met WHERE condition = 'control' GROUP BY 1, 2) b ON a.mode = b.mode AND a.model = b.model")
def a_lift(spark, d):
    m = _metrics(spark, d).groupBy("mode", "model", "condition").agg(F.avg("f1").alias("f1"))
    return evaluate.lift(m.where("condition = 'treatment'"), m.where("condition = 'control'"), ["mode", "model"])


@query(f"WITH {_MET} SELECT model AS feature, round(avg(abs(f1)), 6) AS importance FROM met GROUP BY 1 ORDER BY avg(abs(f1)) DESC, 1 LIMIT 2")
def a_top_features(spark, d):
    return evaluate.top_features(_metrics(spark, d).select(F.col("model").alias("feature"), F.col("f1").alias("value")), 2)


@query(f"""WITH {DENSE}, {_EV}, p AS (SELECT name, asset, label, CASE WHEN time >= onset AND time < crisis_end THEN 'crisis' WHEN time >= onset - INTERVAL 3 DAY AND time < onset THEN 'pre' WHEN time >= crisis_end + INTERVAL 1 DAY AND time < crisis_end + INTERVAL 4 DAY THEN 'post' END AS period FROM lab, ev)
SELECT name, asset, period, count(*) AS n, round(avg((label = 2)::INT), 6) AS rate FROM p WHERE period IS NOT NULL GROUP BY ALL""")
def e_period_rates(spark, d):
    return events.period_rates(_labels(spark, d), _events(spark), "3 days", "1 days", "4 days")


@query("""WITH r AS (SELECT l_returnflag AS k, avg((l_tax > 0.04)::INT) FILTER (l_linestatus = 'F') AS p1, count(*) FILTER (l_linestatus = 'F') AS n1, avg((l_tax > 0.04)::INT) FILTER (l_quantity > 25) AS p2, count(*) FILTER (l_quantity > 25) AS n2 FROM lineitem GROUP BY 1),
q AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN (p1 * n1 + p2 * n2) / (n1 + n2) END AS pool FROM r), z AS (SELECT k, (p1 - p2) / nullif(sqrt(pool * (1 - pool) * (1.0 / nullif(n1, 0) + 1.0 / nullif(n2, 0))), 0) AS z FROM q),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), p AS (SELECT k, z, 2 * exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p FROM t)
SELECT k, round(z, 6) AS z, round(p, 5) AS p_value, p < 0.01 AS significant FROM p""")
def e_proportion_z(spark, d):
    hit = (F.col("l_tax") > 0.04).cast("double")
    r = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.avg(F.when(F.col("l_linestatus") == "F", hit)).alias("p1"), F.count_if(F.col("l_linestatus") == "F").alias("n1"), F.avg(F.when(F.col("l_quantity") > 25, hit)).alias("p2"), F.count_if(F.col("l_quantity") > 25).alias("n2"))
    return events.proportion_z_test(r).select("k", "z", F.round("p_value", 5).alias("p_value"), "significant")


@query(f"WITH {DENSE}, t AS (SELECT time, min((label = 2)::INT) AS lo, max((label = 2)::INT) AS hi FROM lab GROUP BY time HAVING count(*) = 5) SELECT count(*) AS n, round(avg(lo) * 100, 6) AS pct_all, round(avg(hi) * 100, 6) AS pct_any FROM t")
def e_simultaneous_stress(spark, d):
    return events.simultaneous_stress(_labels(spark, d), 5)


@query("""WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)
SELECT n, round(po * 100, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM s""")
def e_cohens_kappa(spark, d):
    return events.cohens_kappa(read(spark, d, "labels"), a="quality", b="toxic")


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) AS n, avg(((l_tax > 0.04) = (l_discount > 0.05))::INT) AS po, avg((l_tax > 0.04)::INT) AS x, avg((l_discount > 0.05)::INT) AS y FROM lineitem GROUP BY 1), e AS (SELECT *, x * y + (1 - x) * (1 - y) AS pe FROM s),
v AS (SELECT k, n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM e)
SELECT k, n, kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM v""")
def e_kappa_band(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_tax") > 0.04).cast("int").alias("a"), (F.col("l_discount") > 0.05).cast("int").alias("b"))
    x = events.cohens_kappa(x, "k").select("k", "n", F.round("kappa", 6).alias("kappa"))
    return x.withColumn("band", events.kappa_band(F.col("kappa")))


@query(f"WITH {DENSE} SELECT asset, time, round((max(price) OVER w - price) / max(price) OVER w * 100, 6) AS drawdown FROM dense WINDOW w AS (PARTITION BY asset, seg ORDER BY time ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")
def e_drawdown(spark, d):
    return events.drawdown(_dense(spark, d).select("asset", "time", "price"), width=SECONDS).select("asset", "time", "drawdown")


@query(f"""WITH {DENSE}, x AS (SELECT asset, time, round((max(price) OVER w - price) / max(price) OVER w * 100, 6) AS drawdown FROM dense WINDOW w AS (PARTITION BY asset, seg ORDER BY time ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
b AS (SELECT asset, quantile_cont(drawdown, 0.95) AS bound FROM x WHERE time < TIMESTAMP '2024-01-11' GROUP BY asset) SELECT x.asset, time, (drawdown > bound)::BIGINT AS flag FROM x JOIN b ON x.asset = b.asset""")
def e_drawdown_flag(spark, d):
    x = rounded(events.drawdown(_dense(spark, d).select("asset", "time", "price"), width=SECONDS).select("asset", "time", "drawdown"))
    return events.drawdown_flag(x, x.where("time < timestamp_ntz'2024-01-11'")).select("asset", "time", "flag")


@query(f"WITH {DENSE}, {_EV} SELECT asset, time, EXISTS (SELECT 1 FROM ev WHERE time BETWEEN onset AND crisis_end)::BIGINT AS in_event FROM lab")
def e_event_window_flag(spark, d):
    return events.event_window_flag(_labels(spark, d).select("asset", "time"), _events(spark)).select("asset", "time", "in_event")


@query(f"WITH {DENSE}, {_EV} SELECT asset, time, label FROM lab WHERE NOT EXISTS (SELECT 1 FROM ev WHERE time >= onset - INTERVAL 2 DAY AND time <= crisis_end + INTERVAL 2 DAY)")
def e_exclude_windows(spark, d):
    return events.exclude_windows(_labels(spark, d).select("asset", "time", "label"), _events(spark), "2 days")


@query(f"""WITH {DENSE}, n AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label OR time - lag(time) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM lab WINDOW w AS (PARTITION BY asset ORDER BY time)),
r AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY time) AS run FROM n), g AS (SELECT asset, run, min(time) AS start, max(time) AS "end", count(*) AS length, avg(price) AS mean_price FROM r WHERE label = 2 GROUP BY asset, run HAVING count(*) >= 2)
SELECT asset, start, "end", length, round(mean_price, 6) AS mean_price, row_number() OVER (PARTITION BY asset ORDER BY length DESC, start) AS rank FROM g QUALIFY rank <= 5""")
def e_stress_runs(spark, d):
    return events.stress_runs(_labels(spark, d), SECONDS, 2)


@query(f"""WITH {DENSE}, s AS (SELECT asset, (CASE WHEN sum((label = 2)::INT) OVER (PARTITION BY time) - (label = 2)::INT > 0 THEN 1 ELSE 0 END) AS b, (label = 2)::INT AS a FROM lab),
k AS (SELECT asset, count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM s GROUP BY asset) SELECT asset, n, round(po * 100, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa FROM k""")
def e_validator_kappa(spark, d):
    x = events.any_other_stress(_labels(spark, d)).withColumn("a", (F.col("label") == 2).cast("int"))
    return events.cohens_kappa(x, "asset", a="a", b="others")


def _probs(spark, d):
    """A stand-in for a model's probability of stress: over 0.85 for the bars that are labelled 2."""
    x = _dense(spark, d)
    prob = F.when(F.col("tense") > 0, F.least(F.lit(1.0), F.col("rv") / F.col("tense") * 0.9)).otherwise(0.0)
    return x.join(F.broadcast(cuts(x)), "asset").select("asset", "time", "price", prob.alias("prob"))  # a row an asset


_PROB = "pr AS (SELECT dense.asset, time, seg, price, CASE WHEN tense > 0 THEN least(1.0, rv / tense * 0.9) ELSE 0.0 END AS prob FROM dense JOIN cut ON dense.asset = cut.asset)"


@query(f"WITH {DENSE}, {_PROB}, x AS (SELECT *, min(prob) OVER w AS lo, count(prob) OVER w AS n FROM pr WINDOW w AS (PARTITION BY asset ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) SELECT asset, min(time) AS signal FROM x WHERE lo > 0.85 AND n = 2 GROUP BY asset")
def e_first_sustained(spark, d):
    return events.first_sustained(_probs(spark, d), "asset")


@query(f"""WITH {DENSE}, {_PROB}, {_EV}, a AS (SELECT DISTINCT asset FROM pr), e AS (SELECT name, asset, onset AS reference FROM ev, a), j AS (SELECT e.*, time, prob FROM e JOIN pr ON pr.asset = e.asset AND time BETWEEN reference - INTERVAL 72 HOUR AND reference),
x AS (SELECT *, min(prob) OVER w AS lo, count(prob) OVER w AS n FROM j WINDOW w AS (PARTITION BY name, asset ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)), f AS (SELECT name, asset, min(time) AS signal FROM x WHERE lo > 0.85 AND n = 2 GROUP BY 1, 2), s AS (SELECT name, asset, count(*) AS rows, max(prob) AS m FROM j GROUP BY 1, 2)
SELECT e.name, e.asset, reference, signal, round((epoch_us(reference) - epoch_us(signal)) / 60000000, 6) AS lead_minutes, round(m, 6) AS max_prob, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'NO_DATA' WHEN signal IS NULL THEN 'NO_SIGNAL' ELSE 'OK' END AS status
FROM e LEFT JOIN s ON e.name = s.name AND e.asset = s.asset LEFT JOIN f ON e.name = f.name AND e.asset = f.asset""")
def e_lead_time(spark, d):
    p = _probs(spark, d)
    e = p.select("asset").distinct().crossJoin(F.broadcast(_events(spark))).select("name", "asset", F.col("onset").alias("reference"), F.lit(72).alias("lookback_hours"))  # two events
    return events.lead_time(p, e)


BLOCK, REPS = 24, 10_000


@query(f"""WITH {DENSE}, {_EV}, pre AS (SELECT name, asset, time, (label = 2)::INT AS flag FROM lab JOIN ev ON time >= onset - INTERVAL 30 DAY AND time < onset), crisis AS (SELECT name, asset, count(*) AS m, avg((label = 2)::INT) AS observed FROM lab JOIN ev ON time >= onset AND time < crisis_end GROUP BY 1, 2),
x AS (SELECT name, asset, flag, row_number() OVER w - 1 AS i, coalesce(sum(flag) OVER (PARTITION BY name, asset ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pre WINDOW w AS (PARTITION BY name, asset ORDER BY time)),
n AS (SELECT name, asset, count(*) AS n, sum(flag) AS total, avg(flag) AS pre_rate FROM x GROUP BY 1, 2), t AS (SELECT * FROM n JOIN crisis USING (name, asset)),
r AS (SELECT *, unnest(generate_series(0, {REPS} - 1)) AS rep FROM t), k AS (SELECT *, unnest(generate_series(0, (m + {BLOCK} - 1) // {BLOCK} - 1)) AS k FROM r),
dr AS (SELECT *, ('0x' || substr(md5(concat_ws('/', name, asset, rep, k, 1)), 1, 15))::BIGINT % n AS a, least({BLOCK}, m - {BLOCK} * k) AS len FROM k),
s AS (SELECT dr.name, dr.asset, rep, sum(y.before + (a + len) // n * total - x.before) / any_value(m)::DOUBLE AS rate FROM dr JOIN x ON x.name = dr.name AND x.asset = dr.asset AND x.i = a JOIN x y ON y.name = dr.name AND y.asset = dr.asset AND y.i = (a + len) % n GROUP BY 1, 2, 3),
b AS (SELECT name, asset, avg(rate) AS null_mean, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi, greatest(avg((rate >= observed)::INT), {1 / REPS}) AS p FROM s JOIN t USING (name, asset) GROUP BY 1, 2)
SELECT name, asset, n AS n_pre, m AS n_sample, round(pre_rate, 6) AS pre_rate, round(observed, 6) AS observed, round(null_mean + 1e-9, 6) AS null_mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p_value, p < 0.05 AS significant FROM b JOIN t USING (name, asset)""")
def e_block_bootstrap(spark, d):
    tested = events.bootstrap_test(_labels(spark, d), _events(spark), BLOCK, REPS)
    return tested.withColumn("null_mean", F.col("null_mean") + 1e-9)  # halves of the last decimal round alike in all engines


@query(f"""WITH {DENSE}, {_PROB}, h AS (SELECT *, (prob > 0.85)::INT AS hit, sum(1 - (prob > 0.85)::INT) OVER (PARTITION BY asset, seg ORDER BY time) AS g FROM pr)
SELECT asset, time, round(prob, 6) AS prob, CASE WHEN prob >= 0.85 THEN 'stress' WHEN prob >= 0.5 THEN 'elevated' ELSE 'calm' END AS regime, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time)::BIGINT AS consecutive_bars, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time) >= 2 AS warning_active FROM h""")
def s_warning_state(spark, d):
    x = live.warning_state(_probs(spark, d), gap=SECONDS)
    return x.select("asset", "time", "prob", live.regime(F.col("prob")).alias("regime"), "consecutive_bars", "warning_active")


_WARNED = "w AS (SELECT asset, time, price FROM (SELECT *, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time) AS c FROM (SELECT *, (prob > 0.85)::INT AS hit, sum(1 - (prob > 0.85)::INT) OVER (PARTITION BY asset, seg ORDER BY time) AS g FROM pr)) WHERE c >= 2)"


def _outcomes(minutes: int) -> str:
    return f"""o AS (SELECT asset, date_trunc('minute', time) AS bar, min(price) AS low, last(price ORDER BY time, id) AS close FROM trades GROUP BY 1, 2),
    s AS (SELECT w.asset, w.time, w.price, min(low) / w.price - 1 AS lo, arg_max(close, bar) / w.price - 1 AS en FROM w LEFT JOIN o ON o.asset = w.asset AND bar > w.time AND bar <= w.time + INTERVAL {minutes} MINUTE GROUP BY 1, 2, 3)
    SELECT asset, time, round(price, 6) AS price, round(lo * 100, 6) AS min_change_pct, round(en * 100, 6) AS end_change_pct, CASE WHEN lo IS NULL THEN NULL WHEN lo <= -0.003 AND en <= -0.003 THEN 'STRESS_CONFIRMED' WHEN lo <= -0.003 THEN 'STRESS_ABSORBED' WHEN en >= 0.003 THEN 'PRICE_PUMPED' ELSE 'FALSE_POSITIVE' END AS outcome FROM s"""


def _warned(spark, d):
    return live.warning_state(_probs(spark, d), gap=SECONDS).where("warning_active").select("asset", "time", "price")


@query(f"WITH {DENSE}, {_PROB}, {_WARNED}, {_outcomes(30)}")
def s_resolve_outcomes(spark, d):
    return live.resolve_outcomes(_warned(spark, d), trades(spark, d))


@query(f"WITH {TRADES} SELECT asset, date_trunc('hour', time) AS bar, max(time) AS anchor FROM trades GROUP BY 1, 2")
def v_snap_anchor(spark, d):
    return parity.snap_anchor(trades(spark, d), WIDTH)


def _ledger_sql() -> str:
    sides = lambda name: " UNION ALL ".join(f"SELECT asset, bar, '{c}' AS feature, {c}::DOUBLE AS v FROM {name}" for c in LIVE_NAMES)
    ten = ", ".join(f"'{c}'" for c in LIVE_NAMES if c.endswith(f"_{SECONDS}s") or c in ("volume", "rv"))
    signed = ", ".join(f"'{c}_{SECONDS}s'" for c in ("OFI", "TCI", "VWAP_dev"))
    ratio = ", ".join(f"'{c}'" for c in (f"OFI_{SCALES[1]}s", f"TCI_{SCALES[1]}s", f"Kyle_lambda_{SCALES[1]}s", f"Kyle_lambda_{SCALES[2]}s"))
    return f"""f AS ({FEATURES}), a AS (SELECT asset, max(time) AS time FROM trades GROUP BY asset, date_trunc('hour', time)), {LIVE},
    off AS (SELECT *, time AS bar FROM f), liv AS (SELECT *, date_trunc('hour', time) AS bar FROM live), ol AS ({sides("off")}), ll AS ({sides("liv")}),
    v AS (SELECT asset, bar, feature, round(ol.v, 6) AS x, round(ll.v, 6) AS y FROM ol JOIN ll USING (asset, bar, feature) WHERE ol.v IS NOT NULL AND ll.v IS NOT NULL),
    dd AS (SELECT *, abs(x - y) AS ab, abs(x - y) / (abs(x) + 1e-10) AS rel, abs(x) > 0.1 AND abs(y) > 0.1 AND sign(x) <> sign(y) AS flip FROM v),
    ledger AS (SELECT asset, bar, feature, x, y, ab, rel, CASE WHEN rel < 1e-6 OR ab < 1e-4 THEN 'OK' WHEN feature IN ({signed}) OR feature IN ({ratio}) THEN CASE WHEN flip THEN 'FAIL sign' ELSE 'NOTE noise' END
      WHEN feature IN ({ten}) THEN CASE WHEN rel > 1 THEN 'FAIL apart' ELSE 'NOTE noise' END WHEN rel < 0.05 THEN 'NOTE close' ELSE 'FAIL apart' END AS status FROM dd)"""


_LEDGER = _ledger_sql()


def _ledger(spark, d):
    t = trades(spark, d)
    ends = parity.snap_anchor(t, WIDTH)
    lively = features.features_at(t, ends.select("asset", F.col("anchor").alias("time")), SCALES)
    lively = lively.join(ends.withColumnRenamed("anchor", "time"), ["asset", "time"]).drop("time").withColumnRenamed("bar", "time")
    return parity.parity_ledger(rounded(_features(spark, d)), rounded(lively), LIVE_NAMES, SCALES)


@query(f"WITH {DENSE}, {_LEDGER} SELECT asset, bar AS time, feature, x AS offline_value, y AS live_value, round(ab, 6) AS abs_diff, status FROM ledger")
def v_parity_ledger(spark, d):
    return _ledger(spark, d).drop("rel_diff_pct")


@query(f"WITH {DENSE}, {_LEDGER} SELECT feature, count(*) AS n, round(max(ab), 6) AS max_abs_diff, count(*) FILTER (status LIKE 'OK%') AS ok, count(*) FILTER (status LIKE 'NOTE%') AS note, count(*) FILTER (status LIKE 'FAIL%') AS fail FROM ledger GROUP BY feature")
def v_parity_summary(spark, d):
    return parity.parity_summary(_ledger(spark, d)).drop("max_rel_diff_pct")


@query(f"""WITH {DENSE}, {_EV}, p AS (SELECT name, asset, label, CASE WHEN time >= onset AND time < crisis_end THEN 'crisis' WHEN time >= onset - INTERVAL 3 DAY AND time < onset THEN 'pre' WHEN time >= crisis_end + INTERVAL 1 DAY AND time < crisis_end + INTERVAL 4 DAY THEN 'post' END AS period FROM lab, ev),
r AS (SELECT name, asset, period, avg((label = 2)::INT) AS rate FROM p WHERE period IS NOT NULL GROUP BY ALL) SELECT asset, {", ".join(f"round(avg(rate) FILTER (period = '{k}'), 6) AS {k}" for k in ("pre", "crisis", "post"))} FROM r GROUP BY asset""")
def e_period_pivot(spark, d):
    return events.period_pivot(events.period_rates(_labels(spark, d), _events(spark), "3 days", "1 days", "4 days"))


_KAPPAS = f"""{DENSE}, {_EV}, {SPANS}, fo AS (SELECT "window"::BIGINT AS fold, start, stop FROM spans WHERE "window" > 0),
own AS (SELECT fold, asset, quantile_cont(rv, 0.60) AS calm, quantile_cont(rv, 0.85) AS tense FROM dense JOIN fo ON time < start GROUP BY 1, 2),
lb AS (SELECT fold, 'global' AS hmm_type, asset, time, label FROM lab JOIN fo ON time >= start AND time < stop
  UNION ALL SELECT fo.fold, 'local', dense.asset, time, (CASE WHEN rv >= own.tense THEN 2 WHEN rv > own.calm THEN 1 ELSE 0 END)::BIGINT FROM dense JOIN fo ON time >= start AND time < stop JOIN own ON own.fold = fo.fold AND own.asset = dense.asset),
dd AS (SELECT asset, time, round((max(price) OVER w - price) / max(price) OVER w * 100, 6) AS drawdown FROM dense WINDOW w AS (PARTITION BY asset, seg ORDER BY time ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
bo AS (SELECT fold, asset, quantile_cont(drawdown, 0.95) AS bound FROM dd JOIN fo ON time < start GROUP BY 1, 2),
x AS (SELECT lb.fold, hmm_type, lb.asset, (label = 2)::INT AS a, (drawdown > bound)::INT AS drawdown, EXISTS (SELECT 1 FROM ev WHERE lb.time BETWEEN onset AND crisis_end)::INT AS timestamp,
  (sum((label = 2)::INT) OVER (PARTITION BY lb.fold, hmm_type, lb.time) - (label = 2)::INT > 0)::INT AS cross_asset FROM lb JOIN dd ON dd.asset = lb.asset AND dd.time = lb.time JOIN bo ON bo.fold = lb.fold AND bo.asset = lb.asset),
st AS (SELECT fold, hmm_type, asset, 'drawdown' AS validator, a, drawdown AS b FROM x UNION ALL SELECT fold, hmm_type, asset, 'timestamp', a, timestamp FROM x UNION ALL SELECT fold, hmm_type, asset, 'cross_asset', a, cross_asset FROM x),
kp AS (SELECT fold, hmm_type, asset, validator, count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM st GROUP BY ALL),
kk AS (SELECT *, po * 100 AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0.0 END AS kappa FROM kp)"""


def _kappas(spark, d):
    """Kappas of the labels of all bars and of labels cut by the windows before a fold, with three validators."""
    x = _dense(spark, d).persist()
    spans = windows(spark, d).where("window > 0").withColumnRenamed("window", "fold")
    inside = (F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop"))
    whole = labels(x).join(F.broadcast(spans), inside).select("fold", F.lit("global").alias("hmm_type"), "asset", "time", "label")
    own = x.join(F.broadcast(spans), F.col("time") < F.col("start")).groupBy("fold", "asset").agg(F.percentile("rv", CALM).alias("calm"), F.percentile("rv", TENSE).alias("tense"))
    local = x.join(F.broadcast(spans), inside).join(F.broadcast(own), ["fold", "asset"])  # a row a fold and asset
    local = local.select("fold", F.lit("local").alias("hmm_type"), "asset", "time", F.when(F.col("rv") >= F.col("tense"), 2).when(F.col("rv") > F.col("calm"), 1).otherwise(0).alias("label"))
    falls = rounded(events.drawdown(x.select("asset", "time", "price"), width=SECONDS).select("asset", "time", "drawdown"))
    return events.validator_kappa(events.validators(whole.unionByName(local), falls, _events(spark), spans.select("fold", "start")))


@query(f"WITH {_KAPPAS} SELECT fold, hmm_type, asset, validator, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM kk")
def e_fold_kappas(spark, d):
    return _kappas(spark, d)


@query(f"WITH {_KAPPAS} SELECT fold, hmm_type, round(avg(kappa) FILTER (validator = 'drawdown'), 6) AS drawdown, round(avg(kappa) FILTER (validator = 'timestamp'), 6) AS timestamp, round(avg(kappa) FILTER (validator = 'cross_asset'), 6) AS cross_asset FROM kk GROUP BY fold, hmm_type")
def e_kappa_matrix(spark, d):
    return events.kappa_matrix(_kappas(spark, d))


_ONSET = f"""{DENSE}, {_PROB}, {_EV}, refs AS (SELECT name, asset, crisis_end AS reference FROM ev, (SELECT DISTINCT asset FROM pr)),
pk AS (SELECT *, max(price) OVER (PARTITION BY asset ORDER BY time RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS peak FROM pr),
onset AS (SELECT r.name, r.asset, min(time) AS drawdown_onset FROM refs r JOIN pk ON pk.asset = r.asset AND time BETWEEN reference - INTERVAL 72 HOUR AND reference WHERE price <= peak * (1 - 0.05) GROUP BY 1, 2)"""


def _references(spark, d):
    return _probs(spark, d).select("asset").distinct().crossJoin(F.broadcast(_events(spark)))  # two events


@query(f"WITH {_ONSET} SELECT * FROM onset")
def e_drawdown_onset(spark, d):
    e = _references(spark, d).select("name", "asset", F.col("crisis_end").alias("reference"), F.lit(72).alias("lookback_hours"))
    return events.drawdown_onset(_probs(spark, d), e)


_LEADS = f"""{_ONSET}, e AS (SELECT name, asset, 'hmm_onset' AS kind, onset AS reference FROM ev, (SELECT DISTINCT asset FROM pr) UNION ALL SELECT name, asset, 'external', reference FROM refs UNION ALL SELECT name, asset, 'drawdown_onset', drawdown_onset FROM onset),
j AS (SELECT e.*, time, prob FROM e JOIN pr ON pr.asset = e.asset AND time BETWEEN reference - INTERVAL 72 HOUR AND reference), x AS (SELECT *, min(prob) OVER w AS lo, count(prob) OVER w AS n FROM j WINDOW w AS (PARTITION BY name, asset, kind ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
f AS (SELECT name, asset, kind, min(time) AS signal FROM x WHERE lo > 0.85 AND n = 2 GROUP BY ALL), s AS (SELECT name, asset, kind, count(*) AS rows FROM j GROUP BY ALL),
leads AS (SELECT name, asset, kind, (epoch_us(reference) - epoch_us(signal)) / 60000000 AS lead_minutes, CASE WHEN rows IS NULL THEN 'NO_DATA' WHEN signal IS NULL THEN 'NO_SIGNAL' ELSE 'OK' END AS status FROM e LEFT JOIN s USING (name, asset, kind) LEFT JOIN f USING (name, asset, kind)
  UNION ALL SELECT name, r.asset, 'drawdown_onset', NULL, 'NO_DRAWDOWN_IN_WINDOW' FROM refs r WHERE NOT EXISTS (SELECT 1 FROM onset o WHERE o.name = r.name AND o.asset = r.asset))"""


def _leads(spark, d):
    p = _probs(spark, d)
    e = _references(spark, d).select("name", "asset", F.col("onset").alias("hmm_onset"), F.col("crisis_end").alias("external"), F.lit(72).alias("lookback_hours"))
    return events.lead_time_multi_ref(p, p, e)


@query(f"WITH {_LEADS} SELECT name, asset, kind, round(lead_minutes, 6) AS lead_minutes, status FROM leads")
def e_lead_time_multi_ref(spark, d):
    return _leads(spark, d).select("name", "asset", "kind", "lead_minutes", "status")


@query(f"""WITH {_LEADS}, g AS (SELECT kind, count(*) AS n, avg(lead_minutes) AS mean, median(lead_minutes) AS median, min(lead_minutes) AS min, max(lead_minutes) AS max FROM leads WHERE status = 'OK' GROUP BY kind)
SELECT kind, n, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, CASE WHEN median >= 30 THEN 'STRONG' WHEN median >= 15 THEN 'USEFUL' WHEN median >= 5 THEN 'MARGINAL' ELSE 'NONE' END AS band FROM g""")
def e_lead_summary(spark, d):
    return events.lead_summary(_leads(spark, d), "kind")


@query(f"WITH {DENSE}, m AS (SELECT asset, label AS state, avg(rv) AS mean FROM dense JOIN lab USING (asset, time) GROUP BY 1, 2) SELECT asset, state, round(mean, 6) AS mean, row_number() OVER (PARTITION BY asset ORDER BY mean, state) - 1 AS label FROM m")
def l_rank_states(spark, d):
    means = labels(x := _dense(spark, d)).join(x.select("asset", "time", "rv"), ["asset", "time"]).groupBy("asset", F.col("label").alias("state")).agg(F.avg("rv").alias("mean"))
    return regimes.rank_states(means)


@query(f"""WITH {DENSE}, h AS (SELECT asset, label AS state, dayofmonth(time) <= 15 AS early, avg(rv) AS m, var_pop(rv) AS v FROM dense JOIN lab USING (asset, time) GROUP BY ALL)
SELECT a.asset, round(max(abs(a.m - b.m)), 6) AS max_mean_diff, round(max(abs(a.v - b.v)), 6) AS max_var_diff FROM h a JOIN h b ON a.asset = b.asset AND a.state = b.state AND a.early AND NOT b.early GROUP BY a.asset""")
def l_param_stability(spark, d):
    x = _dense(spark, d)
    x = labels(x).join(x.select("asset", "time", "rv"), ["asset", "time"]).withColumn("early", F.dayofmonth("time") <= 15)
    p = x.groupBy("asset", "early", F.col("label").alias("state"), F.lit("rv").alias("feature")).agg(F.avg("rv").alias("mean"), F.var_pop("rv").alias("var"))
    return regimes.param_stability(p.where("early").drop("early"), p.where("not early").drop("early"))


@query(f"""WITH {DENSE}, h AS (SELECT asset, label, date_part('day', time) <= 15 AS early, lead(label) OVER (PARTITION BY asset, seg, date_part('day', time) <= 15 ORDER BY time) AS nxt, row_number() OVER (PARTITION BY asset, date_part('day', time) <= 15 ORDER BY time) AS i FROM lab),
a AS (SELECT DISTINCT asset FROM h), g AS (SELECT asset, early, x, y FROM a, (SELECT unnest([true, false]) AS early), (SELECT unnest([0, 1, 2]) AS x), (SELECT unnest([0, 1, 2]) AS y)),
t AS (SELECT asset, early, label AS x, nxt AS y, count(*) AS n FROM h WHERE nxt IS NOT NULL GROUP BY ALL), p AS (SELECT g.asset, g.early, g.x, g.y, coalesce(n / sum(n) OVER (PARTITION BY g.asset, g.early, g.x), 0.0) AS v FROM g LEFT JOIN t ON t.asset = g.asset AND t.early = g.early AND t.x = g.x AND t.y = g.y),
s AS (SELECT g.asset, g.early, g.x, max((label = g.x)::INT) AS v FROM (SELECT DISTINCT asset, early, x FROM g) g JOIN h ON h.asset = g.asset AND h.early = g.early AND i = 1 GROUP BY 1, 2, 3)
SELECT p.asset, 'transition' AS block, round(max(abs(p.v - q.v)), 6) AS max_diff FROM p JOIN p q ON p.asset = q.asset AND p.x = q.x AND p.y = q.y AND p.early AND NOT q.early GROUP BY 1
UNION ALL SELECT s.asset, 'start', round(max(abs(s.v - r.v))::DOUBLE, 6) FROM s JOIN s r ON s.asset = r.asset AND s.x = r.x AND s.early AND NOT r.early GROUP BY 1""")
def l_block_stability(spark, d):
    x, blocks = labels(_dense(spark, d)).select("asset", "time", "label"), []
    for early in (True, False):
        part = x.where((F.dayofmonth("time") <= 15) == early)
        states = part.select("asset").distinct().withColumn("state", F.explode(F.array(*map(F.lit, range(3)))))
        steps = regimes.transition_matrix(part, SECONDS).select("asset", F.col("from_label").alias("state"), F.col("to_label").alias("to"), "p")
        moves = states.withColumn("to", F.explode(F.array(*map(F.lit, range(3))))).join(steps, ["asset", "state", "to"], "left").select("asset", F.lit("transition").alias("block"), "state", "to", F.coalesce("p", F.lit(0.0)).alias("value"))
        first = part.groupBy("asset").agg(F.min_by("label", "time").alias("first"))
        starts = states.join(first, "asset").select("asset", F.lit("start").alias("block"), "state", F.lit(-1).alias("to"), (F.col("first") == F.col("state")).cast("double").alias("value"))
        blocks.append(moves.unionByName(starts))
    return regimes.block_stability(*blocks)


@query(f"""WITH {DENSE}, m AS (SELECT asset, time, (CASE WHEN time >= TIMESTAMP '2024-01-16' THEN 'test' ELSE 'train' END) AS role, (label = 2)::BIGINT AS y, row_number() OVER (PARTITION BY asset, time >= TIMESTAMP '2024-01-16' ORDER BY time DESC) AS nth FROM lab)
SELECT asset, time, role, y FROM m WHERE role = 'test' OR nth > 30""")
def m_purge_binarize(spark, d):
    x = _labels(spark, d).withColumns({"role": F.when(F.col("time") >= F.expr("timestamp_ntz'2024-01-16'"), "test").otherwise("train"), "fold": F.lit(1)})
    return model.binarize(model.purge(x, rows=30)).select("asset", "time", "role", "y")


@query("""WITH s AS (SELECT user_id AS k, count(*) AS n, avg((value < 90)::INT) AS a FROM events GROUP BY 1) SELECT k, CASE WHEN a >= 0.9 THEN 'STRONG' WHEN a >= 0.8 THEN 'MODERATE' ELSE 'WEAK' END AS agreement_band, CASE WHEN a - 0.8 > 0.02 THEN 'BETTER' WHEN a - 0.8 < -0.02 THEN 'WORSE' ELSE 'SAME' END AS delta_band, CASE WHEN n < 10 THEN 'too_thin' ELSE 'ok' END AS status FROM s""")
def a_verdict_bands(spark, d):
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < 90).cast("double")).alias("a"))
    return s.select("k", evaluate.verdict_bands(F.col("a")).alias("agreement_band"), evaluate.verdict_bands(None, F.col("a") - 0.8).alias("delta_band"), live.thin_guard(F.col("n")).alias("status"))


@query(f"""WITH {DENSE}, {_PROB}, h AS (SELECT *, (prob > 0.85)::INT AS hit, sum(1 - (prob > 0.85)::INT) OVER (PARTITION BY asset, seg ORDER BY time) AS g FROM pr),
c AS (SELECT asset, time, prob, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time)::BIGINT AS n FROM h), fl AS (SELECT asset, time, CASE WHEN v_buy + v_sell > 0 THEN (v_buy - v_sell) / (v_buy + v_sell) END AS flow FROM dense)
SELECT asset, time, concat_ws(' | ', (CASE WHEN prob >= 0.85 THEN 'stress' WHEN prob >= 0.5 THEN 'elevated' ELSE 'calm' END) || ' bar', CASE WHEN n >= 2 THEN 'warning for ' || n || ' bars' END, CASE WHEN abs(flow) > 0.3 THEN 'extreme flow' END) AS text,
round(prob, 2) AS p, CASE WHEN abs(flow) > 0.3 THEN round(flow, 2) END AS flow FROM c JOIN fl USING (asset, time)""")
def s_interpretation(spark, d):
    x = live.warning_state(_probs(spark, d), gap=SECONDS).withColumn("regime", live.regime(F.col("prob")))
    sides = F.col("v_buy") + F.col("v_sell")
    flow = _dense(spark, d).select("asset", "time", F.when(sides > 0, (F.col("v_buy") - F.col("v_sell")) / sides).alias("OFI"))
    said = live.interpretation(x.join(flow, ["asset", "time"])).select("asset", "time", "interpretation")
    number = lambda pattern: F.regexp_extract("interpretation", pattern, 1).try_cast("double")
    text = F.regexp_replace(F.regexp_replace("interpretation", r" \(p=[^)]*\)", " bar"), r"extreme flow -?[0-9.]+", "extreme flow")  # the numbers stand beside it
    return said.select("asset", "time", text.alias("text"), number(r"p=([0-9.]+)").alias("p"), number(r"extreme flow (-?[0-9.]+)").alias("flow"))
