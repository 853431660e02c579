"""Hidden Markov models by chunks against a loop over each segment."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import regimes

START = datetime.datetime(2024, 1, 31, 20)


def model(seed, k=3, f=2):
    rng = np.random.default_rng(seed)
    t, s = rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    return regimes.Hmm(rng.normal(0, 2, (k, f)), rng.random((k, f)) + 0.3, t / t.sum(axis=1, keepdims=True), s / s.sum())


def by_loop(m, x):
    """Statistics of one sequence, and its best path, row by row."""
    n, k = len(x), len(m.start)
    p = np.exp(m.emission(x))
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * p[0]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.transition) * p[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.transition @ (p[t + 1] * b[t + 1])
    total = a[-1].sum()
    g = a * b / total
    pairs = sum((np.outer(a[t - 1], p[t] * b[t]) * m.transition / total for t in range(1, n)), np.zeros((k, k)))
    stats = np.concatenate([[np.log(total)], g[0], pairs.ravel(), g.sum(axis=0), (g.T @ x).ravel(), (g.T @ (x * x)).ravel()])
    best, back = np.log(m.start) + np.log(p[0]), []
    for t in range(1, n):
        step = best[:, None] + np.log(m.transition)
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + np.log(p[t])
    path = [int(best.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return stats, path[::-1]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 60])
def test_chunks_of_any_size_give_what_a_loop_gives(n):
    models, x = [model(1), model(2)], np.random.default_rng(n).normal(0, 2, (n, 2))
    want = np.stack([by_loop(m, x)[0] for m in models])
    paths = [by_loop(m, x)[1] for m in models]
    for size in (1, 2, 7, 100):
        parts = [x[k : k + size] for k in range(0, n, size)]
        summaries = np.stack([regimes._summary(models, part, not k) for k, part in enumerate(parts)])
        carry = regimes._carry(summaries, 3)
        got = sum(regimes._expect(models, part, not k, carry[k]) for k, part in enumerate(parts))
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9), size
        for m, path in zip(models, paths, strict=True):
            steps = [regimes._log_steps(m, part, not k) for k, part in enumerate(parts)]
            ends = regimes._ends(np.stack([regimes._best_product(s) for s in steps]))
            assert [int(v) for s, e in zip(steps, ends, strict=True) for v in regimes._path(s, *e)] == path, size


def test_fit_and_decode_don_t_depend_on_the_chunks(spark):
    rng, rows = np.random.default_rng(5), []
    for asset in "AB":
        state = 0
        for k in range(700):
            state = state if rng.random() < 0.95 else int(rng.integers(0, 3))
            rows.append((asset, START + datetime.timedelta(minutes=k), float(rng.normal(3 * state, 1)), float(rng.normal(0, 1 + state))))
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, x double, y double").repartition(3)
    fits = [regimes.hmm_fit(df, ("x", "y"), seeds=2, rounds=8, chunk=chunk) for chunk in (1800, 86_400)]
    for key in fits[0]:
        a, b = (f[key] for f in fits)
        assert np.allclose(a.means, b.means) and np.allclose(a.transition, b.transition) and a.score == pytest.approx(b.score)
    paths = [{(r.asset, r.time): r.label for r in regimes.hmm_decode(fits[0], df, ("x", "y"), chunk=chunk).collect()} for chunk in (1800, 86_400)]
    assert paths[0] == paths[1] and len(paths[0]) == 1400
    parts = [(a, m, [r for r in rows if r[0] == a and r[1].month == m]) for a in "AB" for m in (1, 2)]
    for a, m, part in parts:  # a month is a segment
        fitted = fits[0][(a,)]
        rank = np.argsort(np.argsort(fitted.means[:, 0]))
        with np.errstate(all="ignore"):
            assert [paths[0][r[:2]] for r in part] == [int(rank[s]) for s in by_loop(fitted, np.array([r[2:] for r in part]))[1]]


def test_chunks_are_of_rows_and_bars_are_made_once(spark, monkeypatch):
    from tidewatch.plans import training

    rng = np.random.default_rng(7)
    rows = [("A", START + datetime.timedelta(hours=k), float(rng.normal(3 * (k // 9 % 2), 1)), float(rng.normal())) for k in range(24 * 45)]
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, x double, y double").withColumn("month", F.trunc("time", "month"))
    chunks = lambda rows: sorted(len(r._rows) for r in regimes._packed(df, ["asset", "month"], ("x", "y"), rows).collect())
    assert len(chunks(86_400)) == 46
    assert chunks(None) == [4, 24 * 45 - 4 - 24 * 29, 24 * 29]  # a month of hours is one chunk, not a chunk a day
    fits, paths = [], []
    for most in (8_640, 100):
        monkeypatch.setattr(regimes, "ROWS", most)
        fits.append(regimes.hmm_fit(df, ("x", "y"), seeds=2, rounds=5))
        paths.append({(r.asset, r.time): r.label for r in regimes.hmm_decode(fits[0], df, ("x", "y")).collect()})
    assert len(chunks(None)) == 12  # 1, 7 and 4
    a, b = (f[("A",)] for f in fits)
    assert np.allclose(a.means, b.means) and np.allclose(a.variances, b.variances) and np.allclose(a.transition, b.transition)
    assert paths[0] == paths[1] and len(paths[0]) == len(rows)
    monkeypatch.undo()

    found = training.l_local_labels(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "events" in f] and found.count()


def test_labels_of_all_bars_read_trades_once(spark):
    from tidewatch.plans import training

    found = training.l_hmm_labels(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "events" in f] and found.count()
