"""Registered queries of audits by file, modelling and the live path. MLlib's fits and hashes have no SQL; tests/test_training.py tests most of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialise, move, read, scratch
from ..operators import audit, bars, evaluate, model, regimes, transform
from ..streaming import live
from .queries import _PROB, _SUM, _W, _WARNED, SCALES, _dense, _features, _labels, _outcomes, _probs, _warned, query
from .views import BARS, DENSE, FEATURES, SECONDS, TRADES, labels, trades, windows

INPUTS = [f"{c}_{6 * SECONDS}s" for c in ("OFI", "TCI", "intensity", "RV")]
#: Kinds that all, some or none of a column's values have.
_KINDS = {"event_type": "long", "user_id": "tinyint", "event_id": "smallint", "value": "double"}
_SQL_KINDS = {"long": "BIGINT", "double": "DOUBLE"}
_BAD = " UNION ALL ".join(f"SELECT 'events.parquet' AS file, '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS {_SQL_KINDS.get(t, t)}) IS NULL) AS bad_values FROM events" for c, t in _KINDS.items())


@query(_BAD)
def q_schema_check(spark, d):
    raw = read(spark, d, "events")
    return audit.schema_check(raw.withColumns({c: F.col(c).cast("string") for c in _KINDS}), _KINDS)


@query("""WITH c AS (SELECT column_name AS name FROM duckdb_columns() WHERE table_name = 'events'), e AS (SELECT unnest(['event_id', 'value', 'qty', 'props', 'side']) AS name),
l AS (SELECT (SELECT count(*) + 1 FROM c) AS n_columns, (SELECT string_agg(name, ',' ORDER BY name) FROM e WHERE name NOT IN (SELECT name FROM c)) AS lacking)
SELECT event_type AS asset, 'events.parquet' AS file, count(*) AS rows, any_value(n_columns) AS n_columns, any_value(lacking) AS lacking FROM events, l GROUP BY 1""")
def q_feature_inventory(spark, d):
    return audit.feature_inventory(read(spark, d, "events").withColumn("asset", F.col("event_type")), ["event_id", "value", "qty", "props", "side"])


@query()
def d_find_min_d(spark, d):
    return transform.find_min_d(_dense(spark, d).select("asset", "time", "price"), "price", least=1e-2)


_RESAMPLED = 20_000


@query(f"""WITH {DENSE}, c AS (SELECT label, (SELECT count(*) FROM lab) / (3.0::DOUBLE * count(*)) AS weight FROM lab GROUP BY label), x AS (SELECT lab.*, asset || '/' || strftime(time, '%Y-%m-%d %H:%M:%S') AS key, weight FROM lab JOIN c ON lab.label = c.label),
l AS (SELECT label, key, weight * {_RESAMPLED} / (SELECT sum(weight) FROM x) AS l FROM x), m AS (SELECT *, greatest(1, ceil(l))::BIGINT AS m FROM l), d AS (SELECT label, key, l / m AS r, unnest(generate_series(1, m)) AS d FROM m),
u AS (SELECT label, key, r, ('0x' || substr(md5(concat_ws('/', key, d, 0)), 1, 10))::BIGINT / {float(1 << 40)} AS u FROM d),
n AS (SELECT label, key, sum((SELECT count(*) FROM (SELECT unnest(generate_series(1, 19)) AS k) WHERE u >= list_sum(list_transform(generate_series(0, k - 1), lambda j: exp(-r) * pow(r, j) / factorial(j::INT))))) AS n FROM u GROUP BY ALL)
SELECT label, key, n::BIGINT AS n FROM n WHERE n > 0""")
def n_weighted_resample(spark, d):
    x = _labels(spark, d).withColumn("key", F.concat_ws("/", "asset", F.date_format("time", "yyyy-MM-dd HH:mm:ss")))
    weighted = x.join(F.broadcast(transform.class_weights(x)), "label")  # a row a class
    return transform.weighted_resample(weighted, "weight", _RESAMPLED, "key").groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADES} SELECT id, asset, price FROM trades ORDER BY md5(concat_ws('/', id, 0)), id LIMIT 100")
def n_sample_n(spark, d):
    return transform.sample_n(trades(spark, d).select("id", "asset", "price"), 100, "id")


HMM = ("rv", "abs_r")


@query()
def l_hmm_labels(spark, d):
    x = _kept(_dense(spark, d).select("asset", "month", "time", *HMM), "hmm")
    return regimes.hmm_decode(regimes.hmm_fit(x, HMM), x, HMM)


@query()
def l_local_labels(spark, d):
    return regimes.local_labels(_kept(_dense(spark, d).select("asset", "month", "time", *HMM), "hmm"), windows(spark, d), [1, 2], HMM)


@query(f"""WITH {DENSE}, o AS (SELECT asset, time, (CASE WHEN abs_r > 2.0 THEN 2 WHEN abs_r > 1.0 THEN 1 ELSE 0 END) AS y FROM dense),
a AS (SELECT asset, avg((label = y)::INT) * 100 AS agree, abs(avg((label = 2)::INT) - avg((y = 2)::INT)) * 100 AS stress_diff FROM lab JOIN o USING (asset, time) GROUP BY asset)
SELECT f.fold, s.asset, round(CASE WHEN f.fold = 1 THEN agree END, 6) AS agree, round(CASE WHEN f.fold = 1 THEN stress_diff END, 6) AS stress_diff FROM (SELECT unnest([1, 2])::BIGINT AS fold) f, a s""")
def l_global_vs_local(spark, d):
    x = _dense(spark, d)
    other = x.select("asset", "time", F.when(F.col("abs_r") > 2.0, 2).when(F.col("abs_r") > 1.0, 1).otherwise(0).alias("label"))
    agreement = regimes.label_agreement(labels(x), other).withColumn("fold", F.lit(1))
    folds = x.select("asset").distinct().withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2))))
    return regimes.global_vs_local_summary(agreement, folds)  # nothing is known of the second fold


def _folded(spark, d, folds=(2,)) -> DataFrame:
    """Features and labels of the folds, with roles; of the last one alone unless others are named."""
    x = transform.nan_to_num(_features(spark, d).select("asset", "time", *INPUTS), INPUTS)
    j = model.feature_label_join(x, _labels(spark, d).drop("price"))
    return model.walk_forward(j, windows(spark, d), list(folds))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written once, since each round of a fit reads it."""
    return materialise(df, name)


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    x = _kept(model.binarize(model.purge(_folded(spark, d), rows=30)), "split")
    return x.where("role = 'train'"), x.where("role = 'test'")


#: Rounds that the registered queries boost; the operators' default is 300 of depth 6 at a rate of 0.05.
ROUNDS = 20


def _trees(train, inputs, label="y", **how):
    return model.train_boosted(train, inputs, label, rounds=ROUNDS, depth=3, rate=0.2, **how)


@query()
def m_train_lr(spark, d):
    train, test = _split(spark, d)
    return model.predict(model.train_lr(train, INPUTS), test).select("asset", "time", "y_true", "y_pred", F.get(F.col("probs"), F.lit(1)).alias("p"))


@query()
def m_train_rf(spark, d):
    train, test = _split(spark, d)
    return model.predict(model.train_rf(train, INPUTS, trees=20, depth=6), test).select("asset", "time", "y_true", "y_pred", F.get(F.col("probs"), F.lit(1)).alias("p"))


@query()
def m_train_boosted(spark, d):
    train, test = _split(spark, d)
    return model.predict(_trees(train, INPUTS), test).select("asset", "time", "y_true", "y_pred", F.get(F.col("probs"), F.lit(1)).alias("p"))


@query()
def m_train_boosted_classes(spark, d):
    """The three labels by softmax."""
    x = _kept(model.purge(_folded(spark, d), rows=30), "split")
    found = model.predict(_trees(x.where("role = 'train'"), INPUTS, "label", classes=3), x.where("role = 'test'"), "label")
    return found.select("asset", "time", "y_true", "y_pred", *(F.get("probs", F.lit(k)).alias(f"p{k}") for k in range(3)))


@query()
def m_multi_seed_sweep(spark, d):
    path, folded = scratch(spark, "sweep"), _kept(_folded(spark, d, (1, 2)), "folded")
    for scope in ("pooled", "view"):
        model.multi_seed_sweep(folded, INPUTS, path, folds=(1, 2), scope=scope, rounds=ROUNDS, depth=3, rate=0.2)
    return evaluate.classification_report(spark.read.parquet(path), "scope", "mode", "fold", "seed")


@query()
def m_cross_eval(spark, d):
    x = _kept(model.binarize(_folded(spark, d)), "folded")
    other = x.withColumn("y", (F.col(INPUTS[-1]) > 1.0).cast("int"))
    return model.cross_eval(x, other, INPUTS, model.train_lr)


@query()
def m_ablation_run(spark, d):
    x = _kept(_folded(spark, d), "folded")
    differenced = _kept(transform.fracdiff_short(x.select("asset", "time", INPUTS[-1]), INPUTS[-1], 0.4, 1e-2), "differenced")
    return model.ablation_run(x, differenced, [INPUTS[-1]], INPUTS, {"lr": model.train_lr, "boosted": _trees}, fold=2)


@query()
def a_permutation_importance(spark, d):
    train, test = _split(spark, d)
    test = test.withColumn("key", F.concat_ws("/", "asset", "time"))
    right = lambda x: x.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] or 0.0
    rows = evaluate.permutation_importance(model.train_lr(train, INPUTS), test, INPUTS, "key", right)
    return spark.createDataFrame(rows, "feature string, loss double")  # a row a feature


#: A stream is played in so many parts, and is stopped after each and started again from its checkpoint.
PARTS = 5


def _parts(spark: SparkSession, rows: DataFrame, name: str, play, arrived=None, plain: bool = False) -> None:
    """Plays rows in PARTS equal spans of time (or of what arrived says, in microseconds): each is added to a folder, and play is called with a stream over that. plain: rows are read from a table as they are, so they are not written before they are cut."""
    us = F.unix_micros(F.col("time").cast("timestamp")) if arrived is None else arrived
    kept = rows if plain else _kept(rows, f"{name}-rows")
    first, last = kept.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - F.lit(first)) * PARTS / F.lit((last or 0) - (first or 0) + 1))
    # all parts are written at once; then each joins the stream's folder
    cut, source = scratch(spark, f"{name}-cut"), scratch(spark, f"{name}-in")
    kept.withColumn("_part", part).write.partitionBy("_part").parquet(cut)
    for k in range(PARTS if first is not None else 1):
        if not move(spark, f"{cut}/_part={k}", f"{source}/{k}"):
            kept.limit(0).write.parquet(f"{source}/{k}")  # a part without rows is a batch too
        play(spark.readStream.schema(rows.schema).parquet(f"{source}/*")).trigger(availableNow=True).start().awaitTermination()


def _played(spark: SparkSession, rows: DataFrame, run, name: str, plain: bool = False) -> DataFrame:
    """What a stream over rows leaves in its Parquet sink."""
    path, state, made = scratch(spark, name), scratch(spark, f"{name}-state"), []

    def play(source):
        made.append(run(source))
        return live.sink(made[-1], path, state)

    _parts(spark, rows, name, play, plain=plain)
    return spark.read.schema(made[-1].schema).parquet(path).withColumn("time", F.col("time").cast("timestamp_ntz"))


def _ticks(spark, d) -> DataFrame:
    return trades(spark, d).withColumn("time", F.col("time").cast("timestamp"))


_CLOSED = "<= (SELECT max(time) - INTERVAL 30 SECOND FROM trades)"


@query(f"WITH {BARS} SELECT asset, time, v_buy, v_sell, n_buy, n_sell, volume, round(quote, 6) AS quote, price FROM bars WHERE time + INTERVAL 1 HOUR {_CLOSED}")
def s_stream_bars(spark, d):
    return _played(spark, _ticks(spark, d), lambda t: live.stream_bars(t, f"{SECONDS} seconds"), "stream-bars", plain=True)


#: A trade arrives so many microseconds late (two days) for each unit of its id modulo five.
_DELAY = 172_800_000_000


@query(f"""WITH {TRADES}, arr AS (SELECT *, epoch_us(time) + id % 5 * {_DELAY} AS a FROM trades), p AS (SELECT *, (a - min(a) OVER ()) * {PARTS} // (max(a) OVER () - min(a) OVER () + 1) AS part FROM arr),
m AS (SELECT part, max(max(epoch_us(time))) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM p GROUP BY part)
SELECT part::BIGINT AS batch_id, asset, count(*) AS n_read, count(*) FILTER (epoch_us(date_trunc('hour', time)) + 3600000000 <= (latest - 30000000) // 1000 * 1000) AS n_late FROM p JOIN m USING (part) GROUP BY ALL""")
def s_late_rows(spark, d):
    """Trades that arrive up to eight days late, landed in parts: what each part has too late for its bar."""
    path, state = scratch(spark, "landed"), scratch(spark, "landed-state")
    arrived = F.unix_micros("time") + F.col("id") % 5 * _DELAY
    _parts(spark, _ticks(spark, d), "landing", lambda x: live.land(x, path, state, f"{SECONDS} seconds"), arrived)
    found = [spark.read.parquet(f"{path}/{k}").select("batch_id", "asset", F.lit(k == "late").alias("late")) for k in ("on_time", "late")]
    return found[0].unionByName(found[1]).groupBy(F.col("batch_id").cast("long").alias("batch_id"), "asset").agg(F.count(F.lit(1)).alias("n_read"), F.count_if("late").alias("n_late"))


@query(f"""WITH {DENSE}, f AS ({FEATURES}), c AS (SELECT asset, max(time) AS last FROM bars WHERE time + INTERVAL 1 HOUR {_CLOSED} GROUP BY asset), n AS (SELECT asset, time, sum(n_buy + n_sell) OVER (PARTITION BY asset, month ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS n_trades FROM dense)
SELECT f.* EXCLUDE (month), n_trades, CASE WHEN n_trades < 10 THEN 'too_thin' ELSE 'ok' END AS status FROM f JOIN c ON f.asset = c.asset AND f.time <= c.last JOIN n ON n.asset = f.asset AND n.time = f.time""")
def s_stream_features(spark, d):
    return _played(spark, _ticks(spark, d), lambda t: live.stream_features(live.stream_tick_bars(t, f"{SECONDS} seconds"), SECONDS), "stream-features", plain=True)


@query(f"WITH {DENSE} SELECT asset, time, round(price, 6) AS price, round(CASE WHEN row_number() OVER w >= {len(_W)} THEN {_SUM} ELSE price END, 6) AS price_fd FROM dense WINDOW w AS (PARTITION BY asset, month ORDER BY time)")
def s_fracdiff_price(spark, d):
    return live.fracdiff_price(_dense(spark, d).select("asset", "time", "price"), _W)


@query(f"WITH {DENSE} SELECT asset, time, round(price, 6) AS price, round(CASE WHEN row_number() OVER w >= {len(_W)} THEN {_SUM} ELSE price END, 6) AS price_fd FROM dense WINDOW w AS (PARTITION BY asset, month ORDER BY time)")
def s_stream_fracdiff_price(spark, d):
    rows = _dense(spark, d).select("asset", F.col("time").cast("timestamp").alias("time"), "price")
    return _played(spark, rows, lambda x: live.stream_fracdiff_price(x, _W), "stream-fracdiff")


@query(f"WITH {DENSE}, {_PROB}, {_WARNED}, {_outcomes(30)} WHERE epoch_us(time) + 1800000000 < (SELECT max(epoch_us(t)) - 30000000 FROM (SELECT max(bar) AS t FROM o UNION ALL SELECT max(time) FROM w)) // 1000 * 1000")
def s_stream_outcomes(spark, d):
    ticks, at = _ticks(spark, d), F.col("time").cast("timestamp").alias("time")
    minutes = bars.ohlc(ticks).select("asset", F.col("bar").alias("time"), F.lit(None).cast("double").alias("price"), "low", "close")
    rows = minutes.unionByName(_warned(spark, d).select("asset", at, "price"), allowMissingColumns=True)
    return _played(spark, rows, lambda x: live.stream_outcomes(x.withWatermark("time", live.LATE)), "stream-outcomes")


@query()
def s_stream_score(spark, d):
    train, test = _split(spark, d)
    fitted = model.train_lr(train, INPUTS)
    rows = test.select("asset", F.col("time").cast("timestamp").alias("time"), *INPUTS)
    return _played(spark, rows, lambda x: live.stream_score(x, fitted).select("asset", "time", "prob", "regime"), "stream-score")


@query(f"""WITH {DENSE}, {_PROB}, h AS (SELECT *, (prob > 0.85)::INT AS hit, sum(1 - (prob > 0.85)::INT) OVER (PARTITION BY asset, seg ORDER BY time) AS g FROM pr)
SELECT asset, time, round(prob, 6) AS prob, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time)::BIGINT AS consecutive_bars, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time) >= 2 AS warning_active FROM h""")
def s_stream_warnings(spark, d):
    rows = _probs(spark, d).select("asset", F.col("time").cast("timestamp").alias("time"), "prob")
    return _played(spark, rows, lambda x: live.stream_warnings(x, gap=SECONDS), "stream-warnings")


_ENDED = "epoch_us(time) + 1800000000 < (SELECT max(epoch_us(t)) - 30000000 FROM (SELECT max(bar) AS t FROM o UNION ALL SELECT max(time) FROM pr)) // 1000 * 1000"


@query(f"""WITH {DENSE}, {_PROB}, {_WARNED}, h AS (SELECT *, (prob > 0.85)::INT AS hit, sum(1 - (prob > 0.85)::INT) OVER (PARTITION BY asset, seg ORDER BY time) AS g FROM pr), done AS (WITH {_outcomes(30)} WHERE {_ENDED})
SELECT 'score' AS kind, asset, time, round(price, 6) AS price, round(prob, 6) AS prob, CASE WHEN prob >= 0.85 THEN 'stress' WHEN prob >= 0.5 THEN 'elevated' ELSE 'calm' END AS regime, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time)::BIGINT AS consecutive_bars, sum(hit) OVER (PARTITION BY asset, seg, g ORDER BY time) >= 2 AS warning_active,
NULL AS min_change_pct, NULL AS end_change_pct, NULL AS outcome FROM h UNION ALL SELECT 'outcome', asset, time, price, NULL, NULL, NULL, NULL, min_change_pct, end_change_pct, outcome FROM done""")
def s_live_tables(spark, d):
    at = F.col("time").cast("timestamp").alias("time")
    minutes = bars.ohlc(_ticks(spark, d)).select("asset", F.col("bar").alias("time"), "low", "close")
    rows = _probs(spark, d).select("asset", at, "price", "prob").unionByName(minutes, allowMissingColumns=True)
    paths, state = {k: scratch(spark, f"live-{k}") for k in live.TABLES}, scratch(spark, "live-state")
    _parts(spark, rows, "live", lambda x: live.live_tables(live.stream_live(x.withWatermark("time", live.LATE), gap=SECONDS), paths["score"], paths["outcome"], state))
    scores, outcomes = (spark.read.parquet(paths[k]).withColumn("kind", F.lit(k)).drop("batch_id") for k in live.TABLES)
    return scores.unionByName(outcomes, allowMissingColumns=True).withColumn("time", F.col("time").cast("timestamp_ntz"))
