"""Scans by chunks against loops over each asset, on bars with gaps, and across the ends of months."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scan
from tidewatch.operators import evaluate, events, model, regimes, transform
from tidewatch.streaming import live

START, STEP, CHUNK = datetime.datetime(2020, 1, 31, 23, 50), 10, 70


@pytest.fixture(scope="module")
def made(spark):
    """Bars of 10 seconds of three assets, with gaps of all lengths, over the end of a month; values with nulls and bad ones."""
    rng, rows = np.random.default_rng(3), []
    for asset in "ABC":
        at = 0
        for _ in range(160):
            at += 1 if rng.random() > 0.06 else int(rng.integers(2, 60))
            v = float(rng.normal(100, 5))
            rows.append((asset, START + datetime.timedelta(seconds=STEP * at), [v, v, v, v, None, -1.0, float("inf")][int(rng.integers(0, 7))], int(rng.integers(0, 3)) if rng.random() < 0.3 else 2, v))
    rows.append(("D", START, 5.0, 1, 1.0))
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, price double, label int, v double").repartition(5)
    return df, rows


def segments(rows):
    """Each asset's bars in order, parted at gaps."""
    out = []
    for r in sorted(rows, key=lambda r: r[:2]):
        if not out or out[-1][-1][0] != r[0] or (r[1] - out[-1][-1][1]).total_seconds() > STEP:
            out.append([])
        out[-1].append(r)
    return out


def test_run_length(made):
    df, rows = made
    want = {}
    for s in segments(rows):
        n = 0
        for r in s:
            n = n + 1 if r[3] == 2 else 0
            want[r[:2]] = n
    for chunk in (20, CHUNK, 86_400):
        got = scan.run_length(df, F.col("label") == 2, "n", STEP, chunk=chunk)
        assert got.columns == [*df.columns, "n"] and {(r.asset, r.time): r.n for r in got.collect()} == want
    n, no_gap = 0, {}
    for k, r in enumerate(sorted(rows, key=lambda r: r[:2])):
        n = 0 if r[3] != 2 else n + 1 if k and sorted(rows, key=lambda r: r[:2])[k - 1][0] == r[0] else 1
        no_gap[r[:2]] = n
    assert {(r.asset, r.time): r.n for r in scan.run_length(df, F.col("label") == 2, "n", chunk=CHUNK).collect()} == no_gap
    assert max(want.values()) > CHUNK // STEP  # longer than a chunk
    warned = live.warning_state(df.withColumn("prob", F.when(F.col("label") == 2, 0.9).otherwise(0.1)), k=3, gap=STEP)
    assert {(r.asset, r.time): (r.consecutive_bars, r.warning_active) for r in warned.collect()} == {k: (n, n >= 3) for k, n in want.items()}


def test_rows_in_reach(made):
    df, rows = made
    for chunk in (20, CHUNK, 86_400):
        x = scan.in_reach(df, 9, STEP, chunk=chunk)
        got = scan.own_rows(x.withColumn("last", F.collect_list("v").over(scan.reach_window().rowsBetween(-9, 0))))
        want = {r[:2]: [q[4] for q in s[max(0, k - 9) : k + 1]] for s in segments(rows) for k, r in enumerate(s)}
        assert {(r.asset, r.time): r["last"] for r in got.collect()} == want


def test_carried(made):
    df, rows = made
    got = scan.carried(df, {"held": F.col("price"), "label": F.when(F.col("label") == 1, F.col("label"))}, chunk=CHUNK).collect()
    held, ones, asset = None, None, None
    want = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        if r[0] != asset:
            held, ones, asset = None, None, r[0]
        held, ones = r[2] if r[2] is not None else held, 1 if r[3] == 1 else ones
        want[r[:2]] = (held, ones)
    assert {(r.asset, r.time): (r.held, r.label) for r in got} == want


def test_operators_end_at_gaps(made):
    df, rows = made
    parts = segments(rows)
    before = {s[k][:2]: s[k - 1][3] for s in parts for k in range(1, len(s))}
    assert {(r.asset, r.time): r.y_pred for r in evaluate.persistence_baseline(df).collect()} == before
    steps = {}
    for s in parts:
        for a, b in zip(s, s[1:], strict=False):
            steps[(a[0], a[3], b[3])] = steps.get((a[0], a[3], b[3]), 0) + 1
    assert {(r.asset, r.from_label, r.to_label): r.n for r in regimes.transition_matrix(df).collect()} == steps
    seqs = {s[k][:2]: [q[4] for q in s[k - 4 : k + 1]] for s in parts for k in range(4, len(s))}
    assert {(r.asset, r.time): [v[0] for v in r.seq] for r in model.sequences(df, ["v"], 5).collect()} == seqs
    falls = {}
    for s in parts:
        held, last = [], None
        for r in s:
            last = r[2] if r[2] is not None and 0 < r[2] < math.inf else last
            held.append(last)
            peak = max((h for h in held[-13:] if h is not None), default=None)
            falls[r[:2]] = None if last is None else (peak - last) / peak * 100
    got = {(r.asset, r.time): r.drawdown for r in events.drawdown(df.select("asset", "time", "price")).collect()}
    assert got.keys() == falls.keys() and all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)) for k, v in falls.items())
    runs = []
    for s in parts:
        for k, r in enumerate(s):
            if not k or s[k - 1][3] != r[3]:
                runs.append([r[0], r[1], r[3], 0])
            runs[-1][3] += 1
    assert sorted((r.asset, r.start, r.label, r.length) for r in events.label_runs(df.select("asset", "time", "label"), STEP).collect()) == sorted(map(tuple, runs))


def test_months_are_differenced_by_themselves(spark):
    feb, jun = datetime.datetime(2020, 2, 29, 23, 0), datetime.datetime(2020, 6, 1)
    rng = np.random.default_rng(1)
    rows = [("A", t + datetime.timedelta(seconds=STEP * k), float(v), float(w), f"n{k}") for t, n in ((feb, 300), (jun, 500)) for k, (v, w) in enumerate(rng.normal(100, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, price double, volume double, note string").repartition(3)
    weights = np.array(transform.fracdiff_weights(0.4, 1e-2))
    by_d = {"price": np.array(transform.fracdiff_weights(0.4, 1e-3)), "volume": np.array(transform.fracdiff_weights(0.7, 1e-3))}

    def filtered(x, w):
        y = np.convolve(x, w)[: len(x)]
        y[: len(w)] = 0
        return y

    want, long = {}, {}
    for month in (2, 6):
        part = [r for r in rows if r[1].month == month]
        want |= dict(zip((r[1] for r in part), filtered(np.array([r[2] for r in part]), weights), strict=True))
        long |= {r[1]: (a, b, r[4]) for r, a, b in zip(part, filtered(np.array([r[2] for r in part]), by_d["price"]), filtered(np.array([r[3] for r in part]), by_d["volume"]), strict=True)}
    # February ends after 360 bars of which 300 are there, so that a month begins anew
    got = {r.time: r.price for r in transform.fracdiff_short(df, "price", 0.4, 1e-2).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(v) for t, v in want.items())
    for chunk in (200, 1200, 86_400):
        x = transform.fracdiff(df, {"price": 0.4, "volume": 0.7}, least=1e-3, chunk=chunk)
        assert x.columns == df.columns
        found = {r.time: (r.price, r.volume, r.note) for r in x.collect()}
        assert found.keys() == long.keys() and all(found[t][:2] == pytest.approx(v[:2], abs=1e-8) and found[t][2] == v[2] for t, v in long.items())
    first = live.fracdiff_price(df, list(weights)).where("time < '2020-03-01' or time < '2020-06-01 00:02:00'").orderBy("time").collect()
    assert all(r.price_fd == r.price for r in first if r.time.month == 6 and r.time < jun + datetime.timedelta(seconds=STEP * (len(weights) - 1)))


def test_find_min_d_by_month(spark):
    rng = np.random.default_rng(6)
    times = [datetime.datetime(2020, m, 1) + datetime.timedelta(hours=k) for m in (1, 3) for k in range(300)]
    rows = [("noise", t, float(v)) for t, v in zip(times, rng.normal(size=600), strict=True)] + [("steps", t, float(v + 1000 * (t.month == 3))) for t, v in zip(times, rng.normal(size=600), strict=True)] + [("few", t, 1.0 + k % 3) for k, t in enumerate(times[:60])]
    found = {r.asset: r.d for r in transform.find_min_d(spark.createDataFrame(rows, "asset string, time timestamp, v double"), "v", grid=(0.1, 0.9), least=1e-2).collect()}
    assert found["noise"] == 0.1 and found["few"] == 1.0


def test_no_window_by_asset_alone_on_bars(made):
    """Windows over bars are by asset and chunk; those by asset alone run over the table of chunks."""
    df, _ = made
    for x in (events.drawdown(df), events.label_runs(df, STEP), evaluate.persistence_baseline(df), regimes.transition_matrix(df).select("asset", "n"), model.sequences(df, ["v"], 5), live.warning_state(df.withColumn("prob", F.lit(0.9)), gap=STEP)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "windowspecdefinition(asset" in line:
                spec = line.split("windowspecdefinition(", 1)[1].split(" ASC", 1)[0]
                assert "_chunk" in spec, line


def test_sketches_of_months_bound_the_rank_error(spark):
    rng, rows = np.random.default_rng(12), []
    for asset, scale in (("A", 1.0), ("B", 30.0)):
        for k in range(12_000):
            v = float(rng.standard_t(3) * scale)
            rows.append((asset, datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=20 * k), [v, v, v, v, v, None, math.inf, math.nan][int(rng.integers(0, 8))]))
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, v double")
    kept = transform.feature_sketches(df, ["v"])
    assert kept.count() == 12  # six months of two assets
    exact = {(r.asset, r.time): r.v for r in transform.clean_features(df, ["v"], top=0.99).collect()}
    for got in (transform.clean_by_sketches(df, kept, ["v"], top=0.99), transform.clean_features(df, ["v"], top=0.99, approximate=True)):
        found = {(r.asset, r.time): r.v for r in got.collect()}
        for asset in "AB":
            values = np.array([v for a, _, v in rows if a == asset and v is not None and math.isfinite(v)])
            filled = {found[a, t] for a, t, v in rows if a == asset and (v is None or not math.isfinite(v))}
            assert len(filled) == 1 and abs((values <= filled.pop()).mean() - 0.5) < 0.003
            bound, right = (max(abs(v) for (a, _), v in x.items() if a == asset) for x in (found, exact))
            whole = np.abs([exact[a, t] if v is None or not math.isfinite(v) else v for a, t, v in rows if a == asset])
            assert abs((whole <= bound).mean() - (whole <= right).mean()) < 0.003
    none = transform.clean_features(df.withColumn("v", F.lit(None).cast("double")), ["v"], approximate=True)
    assert none.where("v is not null").count() == 0 and none.count() == 24_000
