"""Segments, regimes, events, streams and audits on small rows whose answer is known."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit, bars, evaluate, events, features, parity, regimes, transform
from tidewatch.plans import queries, views
from tidewatch.streaming import live

START = datetime.datetime(2024, 1, 1)
TICK = "asset string, id long, time timestamp_ntz, price double, qty double, is_buyer_maker boolean"


def at(seconds, start=START):
    return start + datetime.timedelta(seconds=float(seconds))


def ticks(spark, rows):
    return spark.createDataFrame(rows, TICK).withColumn("quote_qty", F.col("price") * F.col("qty"))


def synthetic(spark, n_bars=40, each=50, seed=42):
    rng = np.random.default_rng(seed)
    when = np.sort(rng.integers(0, 10_000_000, (n_bars, each)), axis=1) + np.arange(n_bars)[:, None] * 10_000_000
    price = 50_000 + rng.normal(0, 3, n_bars * each).cumsum()
    return ticks(spark, [("A", k, at(us / 1e6), float(p), float(q), bool(s)) for k, (us, p, q, s) in enumerate(zip(when.ravel(), price, rng.uniform(0.01, 2, price.size), rng.random(price.size) < 0.5, strict=True))])


def test_months_are_segments_of_their_own(spark):
    feb, mar = datetime.datetime(2020, 2, 29, 23, 59, 45), datetime.datetime(2020, 3, 5)
    rows = [("A", 0, feb, 1.0, 1.0, False), ("A", 1, at(1, feb), 2.0, 1.0, True), ("A", 2, mar, 8.0, 1.0, False), ("A", 3, at(35, mar), 8.5, 2.0, False)]
    t = ticks(spark, rows)
    r = {x.id: x.r for x in bars.log_return(t).collect()}
    assert r == {0: 0.0, 1: 0.5, 2: 0.0, 3: pytest.approx(np.log(8.5 / 8))}
    assert {x.id: x.dt for x in bars.inter_trade_time(t).collect()} == {0: None, 1: 1_000_000, 2: None, 3: 35_000_000}
    grid = bars.bar_deltas(bars.densify(bars.bars(t))).orderBy("time").collect()
    assert [(x.month.month, x.time.second, x.price, round(x.rv, 6), x.volume, x.dp) for x in grid] == [
        (2, 40, 2.0, 0.5, 2.0, 0.0), (3, 0, 8.0, 0.0, 1.0, 0.0), (3, 10, 8.0, 0.0, 0, 0.0), (3, 20, 8.0, 0.0, 0, 0.0), (3, 30, 8.5, round(float(np.log(8.5 / 8)), 6), 2.0, 0.5)
    ]
    f = features.feature_table(t, scales=(1, 3)).orderBy("time").collect()
    assert [x.OFI_30s is None for x in f] == [True, True, True, False, False]


def test_live_features_agree_with_the_table(spark):
    t = synthetic(spark, each=200)
    table = features.feature_table(t)
    ends = parity.snap_anchor(t)
    got = features.features_at(t, ends.select("asset", F.col("anchor").alias("time"))).join(ends.withColumnRenamed("anchor", "time"), ["asset", "time"]).drop("time").withColumnRenamed("bar", "time")
    ledger = parity.parity_ledger(table.orderBy(F.desc("time")).limit(3), got, features.live_names())
    rows = ledger.collect()
    assert len(rows) == 3 * 26
    assert not [r for r in rows if r.status.startswith("FAIL")]
    s = {r.feature: r for r in parity.parity_summary(ledger).collect()}
    assert s["price"].ok == 3 and s["VWAP_300s"].fail == 0


def live_by_hand(rows, asset, z, scales, returns):
    """Features of an anchor at second z by looking at every trade."""
    bar, span = scales[0], scales[-1] + scales[0]
    found = sorted((t, i, p, q, sell) for a, i, t, p, q, sell in rows if a == asset and z - span < t <= z)
    if not found:
        return None
    gaps = [None, *np.diff([f[0] for f in found])]
    near = [1e6 * g for g, f in zip(gaps, found, strict=True) if g is not None and f[0] >= z - bar]
    out = {"n_trades": len(found), "price": found[-1][2], f"CV_dt_{bar}s": np.std(near, ddof=1) / (np.mean(near) + 1e-8) if len(near) > 1 else 0.0}
    for s in scales:
        x = [f for f in found if f[0] >= z - s]
        x = x if len(x) > 1 else found
        buy, sell = sum(f[3] for f in x if not f[4]), sum(f[3] for f in x if f[4])
        out[f"OFI_{s}s"] = (buy - sell) / (buy + sell + 1e-8)
        out[f"intensity_{s}s"] = len(x) / s
        out[f"RV_{s}s"] = np.sqrt(sum(returns[f[1]] ** 2 for f in x))
    price, flow, before = [], [], found[0][2]
    for k in range(span // bar):
        inside = [f for f in found if z - span + k * bar < f[0] <= z - span + (k + 1) * bar]
        before = inside[-1][2] if inside else before
        price.append(before)
        flow.append(sum(-f[3] if f[4] else f[3] for f in inside))
    for s in scales[1:]:
        dp, sv = np.diff(price)[-s // bar :], np.array(flow[-s // bar :])
        ok = dp.std() > 1e-12 and sv.std() > 1e-12
        out[f"Kyle_lambda_{s}s"] = np.cov(dp, sv)[0, 1] / sv.std(ddof=1) / (sv.std(ddof=1) + 1e-8) if ok else 0.0
    return out


def test_features_at_anchors_by_hand(spark):
    rng, scales = np.random.default_rng(3), (10, 20, 60)
    # whole seconds: trades at the same time, on the ends of windows and of bars; B is quiet for long
    rows = [("A", k, int(t), float(100 + k % 7), float(1 + k % 3), bool(k % 2)) for k, t in enumerate(np.sort(rng.integers(0, 200, 150)))]
    rows += [("B", 1000 + k, t, 50.0 + k, 2.0, k == 1) for k, t in enumerate((5, 15, 15, 25, 140))] + [("C", 2000 + k, 10 * k, 10.0, 3.0, False) for k in range(20)]
    t = ticks(spark, [(a, i, at(s), p, q, sell) for a, i, s, p, q, sell in rows])
    returns = {r.id: r.r for r in bars.log_return(t).collect()}
    anchors = [(a, z) for a in "ABC" for z in (0, 5, 10, 15, 24, 25, 26, 35, 74, 75, 85, 86, 140, 150, 199, 230, 259, 260, 400)]
    got = {(r.asset, r.time): r for r in features.features_at(t, spark.createDataFrame([(a, at(z)) for a, z in anchors], "asset string, time timestamp_ntz"), scales).collect()}
    want = {(a, at(z)): w for a, z in anchors if (w := live_by_hand(rows, a, z, scales, returns))}
    assert got.keys() == want.keys() and 30 < len(want) < len(anchors)
    for k, w in want.items():
        assert {c: got[k][c] for c in w} == pytest.approx(w, rel=1e-9, abs=1e-12), k
    assert any(w["Kyle_lambda_60s"] for w in want.values()) and any(w["CV_dt_10s"] for w in want.values())
    assert got["C", at(150)].Kyle_lambda_60s == 0 and got["C", at(150)].CV_dt_10s == 0
    assert features.features_at(t.where("false"), spark.createDataFrame([("A", at(1))], "asset string, time timestamp_ntz")).count() == 0
    with pytest.raises(ValueError):
        features.features_at(t, t, (10, 25))


def test_ledger_statuses(spark):
    names = features.live_names()
    off = [0.0 if n not in ("OFI_10s", "OFI_60s", "RV_300s", "VWAP_300s", "volume") else 0.5 for n in names]
    liv = [{"OFI_10s": -0.5, "OFI_60s": 0.3, "RV_300s": 0.51, "VWAP_300s": 0.9, "volume": 2.0}.get(n, 0.0) for n in names]
    make = lambda v: spark.createDataFrame([("A", START, *v)], "asset string, time timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    got = {r.feature: r.status for r in parity.parity_ledger(make(off), make(liv), names).collect()}
    assert {k: got[k] for k in ("OFI_10s", "OFI_60s", "RV_300s", "VWAP_300s", "volume", "price")} == {"OFI_10s": "FAIL sign", "OFI_60s": "NOTE noise", "RV_300s": "NOTE close", "VWAP_300s": "FAIL apart", "volume": "FAIL apart", "price": "OK"}


def test_lead_lag_and_flat_flow(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    rows = [("L", at(10 * k), float(v), float(v)) for k, v in enumerate(x)] + [("T", at(10 * k), float(x[k - 1]) if k else 0.0, 1.0) for k in range(60)]
    f = spark.createDataFrame(rows, "asset string, time timestamp_ntz, OFI_60s double, OFI_300s double")
    plan = features.contagion_plan(f.unionByName(f.where("asset = 'L'").withColumn("asset", F.lit("M"))), (("L", "T"), ("M", "T"), ("L", "M")))
    got = plan["T"].orderBy("time").collect()
    assert len(got) == 60 and set(plan) == {"T", "M"}
    assert all(r.Lead_Lag_60s_L == pytest.approx(1) and r.Lead_Lag_60s_M == pytest.approx(1) for r in got[7:]) and got[3].Lead_Lag_60s_L == 0
    assert all(r.OFI_corr_300s_L == 0 for r in got)  # one side doesn't vary
    flat = ticks(spark, [("A", k, at(10 * k), 5.0, 1.0, bool(k % 2)) for k in range(31)])
    assert {r.Kyle_lambda_300s for r in features.feature_table(flat).collect()} == {0.0}


def chain(seed, n, means, stay=0.95):
    rng = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < stay else int(rng.choice([s for s in range(3) if s != state]))
        out.append((state, *(rng.normal(m, 0.3) for m in means[state])))
    return out


def test_known_models_are_found_for_each_asset(spark):
    means = {"A": [(1.0, -1.0), (3.0, 0.0), (6.0, 1.0)], "B": [(10.0, 5.0), (14.0, 4.0), (20.0, 0.0)]}
    rows = [(a, at(10 * k, datetime.datetime(2024, m, 1)), float(x), float(y), s) for a in means for m in (1, 2) for k, (s, x, y) in enumerate(chain(hash(a) % 7 + m, 400, means[a]))]
    df = spark.createDataFrame([*rows, ("A", at(10, datetime.datetime(2024, 3, 1)), float("nan"), None, 0)], "asset string, time timestamp_ntz, x double, y double, state int")
    models = regimes.hmm_fit(df.where("time < timestamp_ntz'2024-03-01'"), ("x", "y"), seeds=3)
    assert set(models) == {("A",), ("B",)}
    for a, want in means.items():
        m = models[(a,)]
        order = np.argsort(m.means[:, 0])
        assert np.abs(m.means[order] - want[:]).max() < 0.2
        assert np.abs(np.diag(m.transition) - 0.95).max() < 0.06
    got = regimes.hmm_decode(models, df, ("x", "y")).join(df.select("asset", "time", "state"), ["asset", "time"]).where("time < timestamp_ntz'2024-03-01'").collect()
    assert len(got) == 1600 and np.mean([r.label == r.state for r in got]) > 0.97
    again = regimes.hmm_fit(df.where("time < timestamp_ntz'2024-03-01'"), ("x", "y"), seeds=2)
    schema = "asset string, state int, feature string, mean double, var double"
    diff = regimes.param_stability(*(spark.createDataFrame(regimes.hmm_parameters(m, ("x", "y")), schema) for m in (models, again))).collect()
    assert len(diff) == 2 and all(r.max_mean_diff < 0.05 for r in diff)
    windows = spark.createDataFrame([(0, START, datetime.datetime(2024, 1, 1, 0, 40)), (1, datetime.datetime(2024, 1, 1, 0, 40), datetime.datetime(2024, 1, 15)), (2, datetime.datetime(2024, 2, 1), datetime.datetime(2024, 2, 20))], "window int, start timestamp_ntz, stop timestamp_ntz")
    local = regimes.local_labels(df, windows, [1, 2], ("x", "y"), seeds=2).join(df.select("asset", "time", "state"), ["asset", "time"])
    share = {(r.asset, r.fold): (r.n, r.same) for r in local.groupBy("asset", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("state")).cast("double")).alias("same")).collect()}
    assert {k: n for k, (n, _) in share.items()} == {(a, f): n for a in "AB" for f, n in ((1, 160), (2, 400))}
    assert min(s for _, s in share.values()) > 0.9


def brute_bootstrap(x, m, block, reps, rng):
    starts = rng.integers(0, len(x), (reps, -(-m // block)))
    index = (starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, :m] % len(x)
    return x[index].mean(axis=1)


@pytest.mark.parametrize("n, block, m", [(720, 24, 60), (300, 48, 130), (20, 48, 70)])
def test_bootstrap_has_the_spread_of_random_blocks(spark, n, block, m):
    rng = np.random.default_rng(n)
    x = (np.repeat(rng.random(n // 10 + 1) < 0.3, 10)[:n]).astype(int)
    rows = [("A", at(3600 * k, datetime.datetime(2024, 1, 25)), int(v)) for k, v in enumerate(x)] + [("B", START, 1)]
    series = spark.createDataFrame(rows, "asset string, time timestamp_ntz, flag int")
    targets = spark.createDataFrame([("A", m, 0.5), ("B", 3, 0.5), ("C", 3, 0.5)], "asset string, n_sample int, observed double")
    got = {r.asset: r for r in events.block_bootstrap(series, targets, block, 2000).collect()}
    assert set(got) == {"A", "B"} and got["B"].null_mean == got["B"].p_value == 1.0
    want = brute_bootstrap(x, m, block, 20_000, rng)
    r = got["A"]
    assert abs(r.null_mean - want.mean()) < 0.012 and abs(r.hi - np.percentile(want, 97.5)) < 0.05 and abs(r.lo - np.percentile(want, 2.5)) < 0.05
    assert abs(r.p_value - max(np.mean(want >= 0.5), 1 / 2000)) < 0.03


def test_lead_statuses_and_bands(spark):
    p = spark.createDataFrame([(a, at(60 * k), 100.0 - (6.0 if a == "A" and k == 50 else 0.0), 0.9 if a == "A" and k >= 40 else 0.1) for a in "AB" for k in range(60)], "asset string, time timestamp_ntz, price double, prob double")
    e = spark.createDataFrame([("x", a, at(60 * 55), at(60 * z), 1) for a, z in (("A", 50), ("B", 50), ("C", 50))], "name string, asset string, hmm_onset timestamp_ntz, external timestamp_ntz, lookback_hours int")
    got = {(r.asset, r.kind): (r.status, r.lead_minutes) for r in events.lead_time_multi_ref(p, p, e).collect()}
    assert got == {
        ("A", "hmm_onset"): ("OK", 15.0), ("A", "external"): ("OK", 10.0), ("A", "drawdown_onset"): ("OK", 10.0), ("B", "hmm_onset"): ("NO_SIGNAL", None), ("B", "external"): ("NO_SIGNAL", None),
        ("B", "drawdown_onset"): ("NO_DRAWDOWN_IN_WINDOW", None), ("C", "hmm_onset"): ("NO_DATA", None), ("C", "external"): ("NO_DATA", None), ("C", "drawdown_onset"): ("NO_PRICE_DATA", None),
    }
    leads = spark.createDataFrame([(k, "OK", v) for k, v in (("a", 40.0), ("b", 20.0), ("b", 30.0), ("c", 5.0), ("d", 1.0))] + [("a", "NO_SIGNAL", 1000.0)], "k string, status string, lead_minutes double")
    assert {r.k: (r.n, r.median, r.band) for r in events.lead_summary(leads, "k").collect()} == {"a": (1, 40.0, "STRONG"), "b": (2, 25.0, "USEFUL"), "c": (1, 5.0, "MARGINAL"), "d": (1, 1.0, "NONE")}


def test_stand_ins_meet_every_case(spark):
    d = "/root/testdata/sf0.001"
    assert {r.label for r in queries._labels(spark, d).select("label").distinct().collect()} == {0, 1, 2}
    assert {r.status for r in queries.QUERIES["e_lead_time"](spark, d).collect()} == {"OK", "NO_SIGNAL", "NO_DATA"}
    assert len([r for r in queries.QUERIES["s_warning_state"](spark, d).collect() if r.warning_active]) > 20
    assert queries.QUERIES["e_lead_summary"](spark, d).count() >= 2
    assert views.CALM < views.TENSE


def test_outcomes(spark):
    paths = {"A": (100, 99.0, 99.5), "B": (100, 99.0, 100.1), "C": (100, 99.9, 101.0), "D": (100, 99.9, 100.1)}
    rows = [(a, k, at(60 * m + 5), float(v), 1.0, False) for a, p in paths.items() for k, (m, v) in enumerate(zip((0, 10, 29), p, strict=True))]
    w = spark.createDataFrame([(a, START, 100.0) for a in "ABCDE"] + [("A", at(1800), 99.5)], "asset string, time timestamp_ntz, price double")
    t = ticks(spark, rows)
    want = {("A", 0): "STRESS_CONFIRMED", ("B", 0): "STRESS_ABSORBED", ("C", 0): "PRICE_PUMPED", ("D", 0): "FALSE_POSITIVE", ("E", 0): None, ("A", 30): None}
    assert {(r.asset, r.time.minute): r.outcome for r in live.resolve_outcomes(w, t).collect()} == want


def test_adf_and_its_p_value(spark):
    rng = np.random.default_rng(4)
    noise, walk = rng.normal(size=400), rng.normal(size=400).cumsum()
    rows = [(a, at(i), v) for a, group in (("noise", noise), ("walk", walk), ("flat", np.ones(400)), ("few", noise[:15])) for i, v in enumerate(map(float, group))]
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, v double")
    got = {r.asset: r for r in transform.adf_test(df, ["v"]).collect()}
    assert got["noise"].stationary and not got["walk"].stationary and got["flat"].stationary is None and "few" not in got or got["few"].stationary is None
    one = {r.asset: r for r in transform.adf_test(df, ["v"], lags=1).collect()}["walk"]
    dx = np.diff(walk)
    x, y = np.stack([np.ones(398), walk[1:-1], dx[:-1]], axis=1), dx[1:]
    beta, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
    t = beta[1] / np.sqrt(rest[0] / 395 * np.linalg.inv(x.T @ x)[1, 1])
    assert one.n == 398 and one.lags == 1 and one.t_stat == pytest.approx(t)
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert transform.adf_p(t) == pytest.approx(p, abs=0.001)
    assert transform.adf_p(-30) == 0 and transform.adf_p(5) == 1


def test_auc_needs_no_order_of_all_points(spark):
    rng = np.random.default_rng(5)
    y, score = rng.integers(0, 2, 3000), rng.normal(size=3000).round(2)
    df = spark.createDataFrame([(int(a), float(b + a / 2)) for a, b in zip(y, score, strict=True)], "y int, score double")
    s = np.array([r.score for r in df.collect()])
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.auc(df).first().auc == pytest.approx(want)
    curve = evaluate.roc_curve(df, parts=7).orderBy(F.desc("score")).collect()
    assert curve[0].tpr0 == curve[0].fpr0 == 0 and curve[-1].tpr == curve[-1].fpr == 1
    assert all(a.tpr == pytest.approx(b.tpr0) for a, b in zip(curve, curve[1:], strict=False))


def test_files_with_other_columns(spark, tmp_path):
    x = spark.range(5)
    for name, cols in (("BTC-2022-05", ["a", "b"]), ("BTC-2022-06", ["a", "b"]), ("BTC-2022-07", ["b", "a"]), ("ETH-2022-05", ["a", "b", "c"])):
        x.select(*(F.col("id").alias(c) for c in cols)).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    schemas = audit.file_schemas(spark, f"file://{tmp_path}")
    assert {r.file.rpartition("/")[2]: (r.rows, len(r.columns)) for r in schemas.collect()} == {"BTC-2022-05.parquet": (5, 2), "BTC-2022-06.parquet": (5, 2), "BTC-2022-07.parquet": (5, 2), "ETH-2022-05.parquet": (5, 3)}
    assert [(r.asset, r.file.rpartition("/")[2], r.found) for r in audit.column_mismatches(schemas).collect()] == [("BTC", "BTC-2022-07.parquet", ["b", "a"])]


def test_kappa_of_constant_raters_and_modes(spark):
    same = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert events.cohens_kappa(same).first().kappa == 0
    tie = spark.createDataFrame([("A", at(10 * k), 0 if k < 15 else 2) for k in range(30)], "asset string, time timestamp_ntz, label int")
    assert [r.label for r in bars.resample_mode(tie).collect()] == [2]
    runs = spark.createDataFrame([("A", at(10 * k), x, 1.0 + k) for k, x in ((0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (5, 1), (6, 2), (60, 2))], "asset string, time timestamp_ntz, label int, price double")
    assert [(r.length, r.mean_price) for r in events.stress_runs(runs, 10, 1).orderBy("rank").collect()] == [(3, 4.0), (1, 7.0), (1, 61.0)]
    probs = spark.createDataFrame([(a, at(k), p) for a in "AB" for k, p in enumerate((0.85, 0.8501, 0.86 if a == "A" else 0.85, 0.9))], "asset string, time timestamp_ntz, prob double")
    assert {r.asset: r.signal.second for r in events.first_sustained(probs, "asset").collect()} == {"A": 1}
