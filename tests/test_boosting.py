"""Boosting on histograms against its loop by hand, and on rows whose answer is known."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tidewatch.operators import boosting, model

START = datetime.datetime(2024, 1, 1)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(0).normal(size=(1600, 3))
    y = (x[:, 0] ** 2 + x[:, 1] > 1).astype(int)
    label = np.where(y == 0, 0, np.where(x[:, 2] > 0, 2, 1))
    made = [("A" if k % 2 else "B", START + datetime.timedelta(hours=k), *map(float, v), int(a), int(b), 1 + k // 800, "train" if k % 4 else "test") for k, (v, a, b) in enumerate(zip(x, y, label, strict=True))]
    return spark.createDataFrame(made, "asset string, time timestamp, a double, b double, c double, y int, label int, fold int, role string").repartition(3).cache()


def right(pred):
    return pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]


def test_one_tree_has_the_best_cuts(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (300, 2)).astype(float), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0) for (a, b), c in zip(x, y, strict=True)], "p double, q double, y int, w double").repartition(4)
    fitted = boosting.fit_many(df, ["p", "q"], [boosting.Task((), "y", "w")], rounds=1, depth=2, rate=1.0, share=1.0, columns=1.0)[(42,)]
    tree, g, h = fitted.trees[0][0], 0.5 - y, np.full(300, 0.25)

    def score(use):
        return g[use].sum() ** 2 / (h[use].sum() + 1)

    def best(use):
        return max((score(use & (x[:, f] <= v)) + score(use & (x[:, f] > v)), f, v) for f in (0, 1) for v in range(5) if (use & (x[:, f] <= v)).sum() >= 4 and (use & (x[:, f] > v)).sum() >= 4)

    everything = np.ones(300, bool)
    gain, f, v = best(everything)
    assert tree.feature[0] == f and fitted.edges[f][tree.bin[0]] == v
    for node, use in ((1, x[:, f] <= v), (2, x[:, f] > v)):
        gain, f2, v2 = best(use)
        assert tree.feature[node] == f2 and fitted.edges[f2][tree.bin[node]] == v2
        left = use & (x[:, f2] <= v2)
        assert tree.value[2 * node + 1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))
    at = x[:, f] > v
    assert fitted.probs(x).shape == (300, 2) and at.any()


def test_classes_and_accuracy(rows):
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    how = {"rounds": 20, "depth": 3, "rate": 0.2}
    mine = right(model.predict(model.train_boosted(train, NAMES, "y", **how), test))
    theirs = right(model.predict(model._fit(GBTClassifier(labelCol="y", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.2, seed=1), train, NAMES, "y"), test))
    assert mine > theirs - 0.015 and mine > 0.93
    found = model.predict(model.train_boosted(train, NAMES, "label", **how), test, "label").collect()
    assert sum(r.y_true == r.y_pred for r in found) > 0.9 * len(found) and {r.y_pred for r in found} == {0, 1, 2}
    assert all(len(r.probs) == 3 and sum(r.probs) == pytest.approx(1) and r.probs[r.y_pred] == max(r.probs) for r in found)


def test_margins_written_anew_change_nothing(rows):
    x = rows.withColumn("w", F.lit(1.0))
    fits = [boosting.fit_many(x, NAMES, [boosting.Task(("t",), "label", "w", 3)], (7,), rounds=5, depth=2, rate=0.3, hold=h)[("t", 7)] for h in (2, 100)]
    values = np.random.default_rng(1).normal(size=(50, 3))
    assert np.allclose(fits[0].probs(values), fits[1].probs(values), atol=1e-5)


def test_rows_of_other_tasks_and_missing_values(spark, rows):
    odd = rows.withColumns({"one": F.when(F.col("asset") == "A", F.col("y")), "two": F.when(F.col("asset") == "B", 1 - F.col("y")), "w": F.lit(1.0)})
    odd = odd.withColumn("c", F.when(F.col("c") > 0, F.col("c")))
    found = boosting.fit_many(odd, NAMES, [boosting.Task(("one",), "one", "w"), boosting.Task(("two",), "two", "w")], (1, 2), rounds=8, depth=3, rate=0.3)
    assert set(found) == {("one", 1), ("one", 2), ("two", 1), ("two", 2)}
    values = np.array([[3.0, 3.0, np.nan], [0.0, -3.0, np.nan]])
    for (task, _), m in found.items():
        p = m.probs(values)[:, 1]
        assert (p[0] > 0.7) == (p[1] < 0.3) == (task == "one")
    assert not np.allclose(found["one", 1].probs(values), found["one", 2].probs(values), atol=1e-12)  # other rows and columns
    none = boosting.fit_many(odd.limit(0), NAMES, [boosting.Task(("t",), "one", "w")], rounds=2)[("t", 42)]
    assert none.probs(values).tolist() == [[0.5, 0.5]] * 2


def test_sweep_of_all_folds_modes_and_seeds(spark, rows, tmp_path):
    for _ in range(2):
        model.multi_seed_sweep(rows, NAMES, str(tmp_path), seeds=(1, 2), folds=(1, 2), rounds=8, depth=3, rate=0.3)
    found = spark.read.parquet(str(tmp_path))
    each = {tuple(r)[:-1]: r["count"] for r in found.groupBy("scope", "mode", "fold", "seed").count().collect()}
    assert each == {("pooled", m, f, s): 200 for m in ("binary", "multiclass") for f in (1, 2) for s in (1, 2)}
    assert right(found.where("mode = 'binary'")) > 0.88 and right(found.where("mode = 'multiclass'")) > 0.8
    model.multi_seed_sweep(rows, NAMES, str(tmp_path), seeds=(3,), folds=(1,), modes=("binary",), rounds=2, depth=2)
    assert spark.read.parquet(str(tmp_path)).count() == 1600 + 200  # other partitions stay
