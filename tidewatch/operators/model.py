"""Walk-forward modelling on MLlib."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import in_reach, own_rows, reach_window
from ..functions.tables import materialise, release
from . import boosting
from .evaluate import ablation_compare, classification_report
from .transform import class_weights, swap_columns


def feature_label_join(features: DataFrame, labels: DataFrame) -> DataFrame:
    """M1."""
    return features.join(labels, ["asset", "time"])


def walk_forward(df: DataFrame, windows: DataFrame, folds: list[int]) -> DataFrame:
    """M2: a row for each fold that uses it, with role train (windows before the fold) or test (the fold's own). windows: few rows."""
    j = df.join(F.broadcast(windows), (F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop")))
    j = j.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).where(F.col("window") <= F.col("fold"))
    return j.withColumn("role", F.when(F.col("window") == F.col("fold"), "test").otherwise("train")).drop("start", "stop")


def purge(df: DataFrame, rows: int | None = None, minutes: float = 30, keys: tuple[str, ...] = ("asset", "fold")) -> DataFrame:
    """M3: training rows less the last `rows` of a key, or those within `minutes` of its end; test rows stay."""
    if rows is not None:
        at = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("time")))
        return df.withColumn("_at", at).where((F.col("role") != "train") | (F.col("_at") > rows)).drop("_at")
    ends = df.where("role = 'train'").groupBy(*keys).agg(F.max("time").alias("_end"))
    j = df.join(F.broadcast(ends), list(keys), "left")  # a row a key
    return j.where((F.col("role") != "train") | (F.col("time") <= F.col("_end") - F.expr(f"interval {int(minutes * 60)} seconds"))).drop("_end")


def binarize(df: DataFrame, label: str = "label") -> DataFrame:
    """M4."""
    return df.withColumn("y", (F.col(label) == 2).cast("int"))


def _weighted(train: DataFrame, label: str) -> DataFrame:
    classes = tuple(r[0] for r in train.select(label).distinct().collect())  # the classes
    return train.join(F.broadcast(class_weights(train, label, classes)), label)


def _fit(classifier, train: DataFrame, features: list[str], label: str):
    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), classifier]
    return Pipeline(stages=steps).fit(_weighted(train, label).withColumn(label, F.col(label).cast("double")))


def train_lr(train: DataFrame, features: list[str], label: str = "y"):
    """M5."""
    return _fit(LogisticRegression(labelCol=label, weightCol="weight", maxIter=2000, regParam=1e-4), train, features, label)


def train_rf(train: DataFrame, features: list[str], label: str = "y", trees: int = 200, depth: int = 12, seed: int = 42):
    """M6."""
    return _fit(RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed), train, features, label)


def train_boosted(train: DataFrame, features: list[str], label: str = "y", classes: int | None = None, seed: int = 42, **how):
    """M7: boosting on histograms with balanced classes; logistic for two classes, softmax for more (without `classes`, as many as the labels tell)."""
    classes = classes or max(2, (train.agg(F.max(label)).first()[0] or 0) + 1)
    task = boosting.Task((), label, "weight", classes)
    return boosting.fit_many(_weighted(train, label), features, [task], (seed,), **how)[(seed,)]


def predict(model, test: DataFrame, label: str = "y", *keep: str) -> DataFrame:
    """M8: asset, time, the kept columns, y_true, probs, y_pred."""
    out = model.transform(test)
    probs = F.col("probability") if out.schema["probability"].dataType.typeName() == "array" else vector_to_array("probability")
    return out.select("asset", "time", *keep, F.col(label).cast("int").alias("y_true"), probs.alias("probs"), F.col("prediction").cast("int").alias("y_pred"))


def sequences(df: DataFrame, columns: list[str], length: int = 60, label: str = "label", width: float = 10) -> DataFrame:
    """M9: the last `length` bars as an array of arrays, with the label of the last one; none across a gap (width: seconds of a bar)."""
    x = in_reach(df.select("asset", "time", F.col(label), F.array(*columns).alias("seq")), length - 1, width)
    x = own_rows(x.withColumn("seq", F.collect_list("seq").over(reach_window().rowsBetween(-(length - 1), 0))))
    return x.where(F.size("seq") == length).select("asset", "time", "seq", label)


def gasf(seq):
    """Gramian angular summation field of an array column."""
    lo, hi = F.array_min(seq), F.array_max(seq)
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    x = F.transform(seq, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (v - lo) / span - 1)))
    return F.transform(x, lambda a: F.transform(x, lambda b: a * b - F.sqrt(F.greatest(F.lit(0.0), 1 - a * a)) * F.sqrt(F.greatest(F.lit(0.0), 1 - b * b))))


def surrogate_fidelity(df: DataFrame, p: str, q: str) -> DataFrame:
    """M11."""
    return df.agg(F.avg((F.col(p) == F.col(q)).cast("double")).alias("fidelity"))


SEEDS, FOLDS, MODES = (42, 100, 777, 999, 2026), (1, 2, 3, 4), ("binary", "multiclass")


def multi_seed_sweep(folded: DataFrame, features: list[str], path: str, train=None, seeds: Iterable[int] = SEEDS, folds: Iterable[int] = FOLDS, modes: Iterable[str] = MODES, scope: str = "pooled", **how) -> None:
    """Fits for each fold, seed and mode; predictions overwrite their own partition, so a run can be repeated.

    scope is `pooled` or an asset. Without `train`, all boosted models are fitted together, with `how` as in boosting.fit_many.
    """
    data = folded if scope == "pooled" else folded.where(F.col("asset") == scope)
    if train is None:
        return _boosted_sweep(data, features, f"{path}/scope={scope}", list(seeds), list(folds), list(modes), how)
    for fold in folds:
        part = purge(data.where(F.col("fold") == fold)).persist()
        for mode in modes:
            x = binarize(part) if mode == "binary" else part.withColumn("y", F.col("label"))
            for seed in seeds:
                model = train(x.where("role = 'train'"), features, "y", seed=seed)
                predict(model, x.where("role = 'test'")).write.mode("overwrite").parquet(f"{path}/scope={scope}/mode={mode}/fold={fold}/seed={seed}")
        part.unpersist()


def _boosted_sweep(data: DataFrame, features: list[str], path: str, seeds: list[int], folds: list[int], modes: list[str], how: dict) -> None:
    """The models of all folds, modes and seeds in one fit, their predictions in one job; only the partitions of these are overwritten."""
    x = materialise(binarize(purge(data.where(F.col("fold").isin(folds)))), "sweep")
    train, tasks = x.where("role = 'train'"), []
    classes = {"binary": ("y", 2), "multiclass": ("label", 3)}
    for mode in modes:
        label, count = classes[mode]
        sizes = train.groupBy("fold", label).agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn(f"w_{mode}", F.sum("_n").over(Window.partitionBy("fold")) / (F.count(F.lit(1)).over(Window.partitionBy("fold")) * F.col("_n"))).drop("_n")
        train = train.join(F.broadcast(sizes), ["fold", label])  # a row a fold and class
        for fold in folds:
            train = train.withColumn(f"y_{mode}_{fold}", F.when(F.col("fold") == fold, F.col(label)))
            tasks.append(boosting.Task((mode, fold), f"y_{mode}_{fold}", f"w_{mode}", count))
    models = boosting.fit_many(train, features, tasks, seeds, **how)

    def run(batches):
        for rows in batches:
            for fold, part in rows.groupby("fold"):
                values = part[features].to_numpy(float)
                for mode in modes:
                    for seed in seeds:
                        probs = models[mode, fold, seed].probs(values)
                        yield part[["asset", "time", "fold"]].assign(mode=mode, seed=seed, y_true=part[classes[mode][0]].astype("int32"), probs=list(probs), y_pred=probs.argmax(axis=1).astype("int32"))

    test = x.where("role = 'test'").select("asset", "time", F.col("fold").cast("int").alias("fold"), "label", "y", *(F.col(c).cast("double").alias(c) for c in features))
    found = test.mapInPandas(run, f"asset string, time {dict(x.dtypes)['time']}, fold int, mode string, seed int, y_true int, probs array<double>, y_pred int")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "fold", "seed").parquet(path)
    release(x)


def cross_eval(a: DataFrame, b: DataFrame, features: list[str], train=train_boosted) -> DataFrame:
    """Trained on labels a (with role); reports against a and against b, column `labels`."""
    model = train(a.where("role = 'train'"), features, "y")
    on_a = classification_report(predict(model, a.where("role = 'test'"))).withColumn("labels", F.lit("a"))
    return on_a.unionByName(classification_report(predict(model, b.where("role = 'test'"))).withColumn("labels", F.lit("b")))


def ablation_run(folded: DataFrame, differenced: DataFrame, columns: list[str], features: list[str], trainers: dict, fold: int = 4, modes: Iterable[str] = MODES) -> DataFrame:
    """Weighted f1 of each model and mode on control and on differenced inputs, compared."""
    rows = None
    for condition, x in (("control", folded), ("treatment", swap_columns(folded, differenced, columns))):
        x = binarize(purge(x.where(F.col("fold") == fold)))
        for mode in modes:
            label = "y" if mode == "binary" else "label"
            for name, train in trainers.items():
                r = classification_report(predict(train(x.where("role = 'train'"), features, label), x.where("role = 'test'"), label))
                r = r.where("class = 'weighted avg'").select(F.lit(name).alias("model"), F.lit(mode).alias("mode"), F.lit(condition).alias("condition"), "f1")
                rows = r if rows is None else rows.unionByName(r)
    return ablation_compare(rows, "control", "treatment", "model", "mode")
