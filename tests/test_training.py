"""Fits, resampling and importance on rows whose answer is known."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, model, regimes, transform
from tidewatch.streaming import live

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(0)
    rows = [("A" if k % 2 else "B", START + datetime.timedelta(hours=k), float(x), float(z), 2 if x > 0.5 else 0, 1, "train" if k < 400 else "test", k) for k, (x, z) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "asset string, time timestamp, x double, z double, label int, fold int, role string, key long").cache()
    return df


def right(pred):
    return pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]


@pytest.mark.parametrize("train", [model.train_lr, lambda *a: model.train_rf(*a, trees=10, depth=4), lambda *a: model.train_boosted(*a, rounds=3, depth=3)])
def test_fits_find_the_bound(split, train):
    x = model.binarize(split)
    fitted = train(x.where("role = 'train'"), ["x", "z"])
    pred = model.predict(fitted, x.where("role = 'test'"))
    assert pred.count() == 200
    assert right(pred) > 0.9


def test_permutation_importance(split):
    x = model.binarize(split)
    fitted = model.train_lr(x.where("role = 'train'"), ["x", "z"])
    test = x.unionByName(x.withColumn("key", F.col("key") + 1000)).unionByName(x.withColumn("key", F.col("key") + 2000))
    score = lambda p: p.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    loss = dict(evaluate.permutation_importance(fitted, test, ["x", "z"], "key", score))
    assert abs(loss["z"]) < loss["x"]


@pytest.mark.parametrize("n", [1200, 2, 1, 0])
def test_permuted_values_all_move(spark, n):
    x = spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") != 0, F.col("id")).alias("v"), F.lit("k").alias("kept"))
    got = [(r.key, r.v or 0) for r in evaluate.permuted(x.repartition(5), "v", "key").collect()]
    assert sorted(v for _, v in got) == sorted(k for k, _ in got) == list(range(n))
    assert n == 1 or all(k != v for k, v in got)
    if n > 2:
        again = {r.key: r.v or 0 for r in evaluate.dealt(*evaluate.numbered(x, "key"), "v", 7).collect()}
        assert all(k != v for k, v in again.items()) and again != dict(got)
        apart = sorted(abs(k - v) for k, v in got)
        assert apart[n // 2] > n // 8  # from all over, not from near by


def test_sweep_can_be_repeated(spark, split, tmp_path):
    how = {"train": lambda t, f, y, seed: model.train_rf(t, f, y, trees=3, depth=3, seed=seed), "seeds": (1, 2), "folds": (1,), "modes": ("binary",)}
    for _ in range(2):
        model.multi_seed_sweep(split, ["x", "z"], str(tmp_path), **how)
    found = spark.read.parquet(str(tmp_path))
    assert found.count() == 400
    assert {(r.scope, r["mode"], r.fold, r.seed) for r in found.select("scope", "mode", "fold", "seed").distinct().collect()} == {("pooled", "binary", 1, 1), ("pooled", "binary", 1, 2)}


def test_cross_eval_reports_on_both_labels(split):
    x = model.binarize(split)
    got = {(r.labels, r["class"]): r for r in model.cross_eval(x, x.withColumn("y", 1 - F.col("y")), ["x", "z"], model.train_lr).collect()}
    good = got["a", "accuracy"].f1
    assert good > 0.9 and abs(got["b", "accuracy"].f1 - (1 - good)) < 1e-9
    assert got["a", "1"].support == got["b", "0"].support > 0 and got["a", "weighted avg"].support == 200


def test_ablation_tells_a_lost_column(split):
    trainers = {"lr": model.train_lr, "rf": lambda t, f, y: model.train_rf(t, f, y, trees=10, depth=4)}
    noise = split.select("asset", "time", F.col("z").alias("x"))
    lost = {r.model: r for r in model.ablation_run(split, noise, ["x"], ["x", "z"], trainers, fold=1, modes=("binary",)).collect()}
    assert {m: r.winner for m, r in lost.items()} == {"lr": "control", "rf": "control"}
    assert all(r.control > 0.9 and r.delta < -0.1 for r in lost.values())
    same = model.ablation_run(split, split.select("asset", "time", "x"), ["x"], ["x", "z"], {"lr": model.train_lr}, fold=1).collect()
    assert [(r["mode"], r.winner, r.delta) for r in sorted(same)] == [("binary", "tie", 0.0), ("multiclass", "tie", 0.0)]


def test_scores_of_the_stream_are_those_of_the_table(spark, split, tmp_path):
    x = model.binarize(split)
    fitted = model.train_lr(x.where("role = 'train'"), ["x", "z"])
    test = x.where("role = 'test'")
    want = {(r.asset, r.time): r.probs[1] for r in model.predict(fitted, test).collect()}
    test.select("asset", "time", "x", "z").repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("asset string, time timestamp, x double, z double").parquet(f"{tmp_path}/in")
    scored = live.stream_score(rows, fitted).select("asset", "time", "prob", "regime")
    live.sink(scored, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.asset, r.time): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys() and all(abs(got[k].prob - p) < 1e-12 for k, p in want.items())
    assert all(r.regime == ("stress" if r.prob >= 0.85 else "elevated" if r.prob >= 0.5 else "calm") for r in got.values())
    assert {r.regime for r in got.values()} == {"stress", "elevated", "calm"}


def test_weighted_resample_follows_the_weights(spark):
    x = spark.range(20000).select(F.col("id").alias("key"), (F.col("id") % 4).alias("c")).withColumn("w", F.when(F.col("c") == 0, 0.0).otherwise(F.col("c").cast("double")))
    n = {r.c: r["count"] for r in transform.weighted_resample(x, "w", 12000, "key").groupBy("c").count().collect()}
    assert set(n) == {1, 2, 3}
    assert all(abs(n[c] - 2000 * c) < 300 for c in n)


def test_weighted_resample_has_no_cap(spark):
    x = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") == 7, 499.5).otherwise(1.0).alias("w"))
    n = {r.key: r["count"] for r in transform.weighted_resample(x, "w", 30000, "key").groupBy("key").count().collect()}
    assert abs(n[7] - 10000) < 400
    assert abs(sum(n.values()) - 30000) < 700
    assert max(c for k, c in n.items() if k != 7) > 30  # 20 on average


def test_sample_n_is_the_same_again(spark):
    x = spark.range(1000).withColumnRenamed("id", "key")
    a, b = (transform.sample_n(x.repartition(k), 50, "key").collect() for k in (2, 7))
    assert len(a) == 50 and set(a) == set(b)
    assert set(transform.sample_n(x, 50, "key", seed=1).collect()) != set(a)
    assert transform.sample_n(x, 5000, "key").count() == 1000


def test_find_min_d(spark):
    steps = np.random.default_rng(1).normal(size=600)
    rows = [(a, START + datetime.timedelta(hours=k), float(v)) for a, values in (("noise", steps), ("walk", steps.cumsum())) for k, v in enumerate(values)]
    found = {r.asset: r.d for r in transform.find_min_d(spark.createDataFrame(rows, "asset string, time timestamp, v double"), "v", grid=(0.1, 0.9), least=1e-2).collect()}
    assert found == {"noise": 0.1, "walk": 0.9}


def test_failed_folds_stay_in_the_summary(spark):
    agreement = spark.createDataFrame([(1, "A", 90.0, 10.0, 15.0)], "fold int, asset string, agree double, stress_a double, stress_b double")
    folds = spark.createDataFrame([(1, "A"), (2, "A")], "fold int, asset string")
    got = sorted(map(tuple, regimes.global_vs_local_summary(agreement, folds).collect()))
    assert got == [(1, "A", 90.0, 5.0), (2, "A", None, None)]
