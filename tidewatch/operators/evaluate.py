"""Metrics, baselines and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import band
from ..functions.scan import in_reach, own_rows, reach_window
from ..functions.tables import materialise


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(pred: DataFrame, *keys: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """A1: precision, recall, f1, support of each class, then accuracy, macro and weighted averages, as rows named `class`."""
    counts = pred.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("n"))  # at most classes squared a key
    truth = counts.select(*keys, F.col(y).alias("c"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("predicted"))
    given = counts.select(*keys, F.col(p).alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("predicted"))
    s = truth.union(given).groupBy(*keys, "c").agg(*(F.sum(x).alias(x) for x in ("tp", "support", "predicted")))
    s = s.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})
    s = s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = [F.col(x).cast("double").alias(x) for x in ("precision", "recall", "f1")]
    rows = s.select(*keys, F.col("c").cast("string").alias("class"), *cols, F.col("support").cast("long").alias("support"))
    total = F.sum("support")
    acc = F.sum("tp") / total
    agg = s.groupBy(*keys)
    accuracy = agg.agg(acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")).withColumn("class", F.lit("accuracy"))
    macro = agg.agg(*(F.avg(x).alias(x) for x in ("precision", "recall", "f1")), total.alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = agg.agg(*((F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in ("precision", "recall", "f1")), total.alias("support")).withColumn("class", F.lit("weighted avg"))
    for extra in (accuracy, macro, weighted):
        rows = rows.union(extra.select(*rows.columns))
    return rows


def confusion_matrix(pred: DataFrame, classes: list[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """A2."""
    return pred.groupBy(y).pivot(p, classes).count().na.fill(0)


def roc_curve(scores: DataFrame, *keys: str, y: str = "y", score: str = "score", parts: int = 64) -> DataFrame:
    """A3: true and false positive rates at each distinct score, from high to low, and the rates before it (tpr0, fpr0).

    Points are dealt to ranges of scores by approximate percentiles; sums run within a range and over the small table of
    ranges, so no task sorts all points of a key.
    """
    points = scores.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    bounds = points.groupBy(*keys).agg(F.percentile_approx(score, [k / parts for k in range(1, parts)], 1000).alias("_bounds"))  # a row a key
    on = lambda a, b, *more: a.join(F.broadcast(b), [*keys, *more]) if keys or more else a.crossJoin(F.broadcast(b))
    points = on(points, bounds).withColumn("_part", F.size(F.filter("_bounds", lambda b: b > F.col(score)))).drop("_bounds")
    sums = points.groupBy(*keys, "_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keys)
    over = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sums.select(*keys, "_part", *(F.coalesce(F.sum(f"_{c}").over(over), zero).alias(f"{c}_before") for c in "pn"), *(F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in "pn"))
    w = Window.partitionBy(*keys, "_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    points = on(points, sums, "_part").withColumns({f"{c}_sum": F.col(f"{c}_before") + F.sum(c).over(w) for c in "pn"})
    rates = {"tpr": _ratio(F.col("p_sum"), F.col("p_all")), "fpr": _ratio(F.col("n_sum"), F.col("n_all")), "tpr0": _ratio(F.col("p_sum") - F.col("p"), F.col("p_all")), "fpr0": _ratio(F.col("n_sum") - F.col("n"), F.col("n_all"))}
    return points.withColumns(rates).select(*keys, score, "p", "n", *rates)


def auc(scores: DataFrame, *keys: str, y: str = "y", score: str = "score") -> DataFrame:
    """A3: area by trapezoids."""
    c = roc_curve(scores, *keys, y=y, score=score)
    return c.groupBy(*keys).agg(F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("auc"))


def persistence_baseline(labels: DataFrame, width: float = 10) -> DataFrame:
    """A4: the label of the bar before (width: seconds of a bar); rows after a gap, which have none, are dropped."""
    x = in_reach(labels.select("asset", "time", F.col("label").alias("y_true")), 1, width)
    return own_rows(x.withColumn("y_pred", F.lag("y_true").over(reach_window()))).where("y_pred is not null")


def majority_baseline(labels: DataFrame) -> DataFrame:
    """A5: the most frequent label of the asset, of equally frequent ones the lowest."""
    counts = labels.groupBy("asset", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("asset").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("y_pred"))
    return labels.join(F.broadcast(top), "asset").select("asset", "time", F.col("label").alias("y_true"), "y_pred")  # a row an asset


def class_prevalence(labels: DataFrame, *keys: str) -> DataFrame:
    """A6."""
    counts = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)))


def lift(model: DataFrame, baseline: DataFrame, on: list[str], value: str = "f1") -> DataFrame:
    """A7."""
    j = model.select(*on, F.col(value).alias("model_value")).join(baseline.select(*on, F.col(value).alias("baseline_value")), on)
    return j.withColumn("lift", F.col("model_value") - F.col("baseline_value"))


def stability(metrics: DataFrame, *keys: str, value: str = "f1") -> DataFrame:
    """A8."""
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def fold_progression(metrics: DataFrame, folds: list[int], value: str = "f1") -> DataFrame:
    """A9."""
    wide = metrics.groupBy("mode", "model").pivot("fold", folds).agg(F.avg(value))
    return wide.select("mode", "model", *(F.col(str(f)).alias(f"fold_{f}") for f in folds))


def seed_range(metrics: DataFrame, fold: int, value: str = "f1") -> DataFrame:
    """A10."""
    return metrics.where(F.col("fold") == fold).groupBy("mode", "model").agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), (F.max(value) - F.min(value)).alias("range"))


def best_model(metrics: DataFrame, *keys: str, value: str = "f1") -> DataFrame:
    """The model with the highest mean, of equal ones the first by name."""
    means = metrics.groupBy(*keys, "model").agg(F.avg(value).alias("mean"))
    ranked = means.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), "model")))
    return ranked.where("at = 1").drop("at")


def summary_by_asset(metrics: DataFrame, value: str = "f1") -> DataFrame:
    """A12."""
    return metrics.groupBy("asset", "model").agg(F.avg(value).alias("mean"), F.countDistinct("fold").alias("folds"))


def ablation_compare(metrics: DataFrame, control: str, treatment: str, *keys: str, value: str = "f1", tie: float = 0.001) -> DataFrame:
    """A13."""
    x = metrics.groupBy(*keys).agg(F.avg(F.when(F.col("condition") == control, F.col(value))).alias("control"), F.avg(F.when(F.col("condition") == treatment, F.col(value))).alias("treatment"))
    x = x.withColumn("delta", F.col("treatment") - F.col("control"))
    return x.withColumn("winner", F.when(F.col("delta") > tie, "treatment").when(F.col("delta") < -tie, "control").otherwise("tie"))


def ablation_verdict(compared: DataFrame) -> DataFrame:
    """A14."""
    n = {w: F.count_if(F.col("winner") == w) for w in ("treatment", "control", "tie")}
    verdict = F.when(n["treatment"] > n["control"], "treatment").when(n["treatment"] < n["control"], "control").otherwise("tie")
    return compared.agg(n["treatment"].alias("wins"), n["control"].alias("losses"), n["tie"].alias("ties"), verdict.alias("verdict"))


def verdict_bands(agreement, delta=None):
    """Columns: band of an agreement share, or of a difference."""
    if delta is None:
        return band(agreement, [(0.90, "STRONG"), (0.80, "MODERATE")], "WEAK")
    return F.when(delta > 0.02, "BETTER").when(delta < -0.02, "WORSE").otherwise("SAME")


def top_features(attributions: DataFrame, n: int) -> DataFrame:
    """Rows (feature, value); the n features with the largest mean absolute value."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def numbered(test: DataFrame, key: str, seed: int = 0) -> tuple[DataFrame, int]:
    """test with _i, each row's place (from 0) in the order of its key's hash, and the number of rows.

    Rows are written in ranges of the hash; a range's first place comes from a table of one row a range.
    """
    h = F.xxhash64(key, F.lit(seed))
    x = test.withColumn("_h", h).repartitionByRange("_h", key).sortWithinPartitions("_h", key).drop("_h")
    x = materialise(x.withColumn("_m", F.monotonically_increasing_id()), "numbered")  # the range, and the place in it
    ranges = x.groupBy(F.shiftright("_m", 33).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))  # a row a range
    x = x.withColumn("_r", F.shiftright("_m", 33)).join(F.broadcast(starts), "_r")
    place = (F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return x.withColumn("_i", place).drop("_r", "_m", "_at"), x.count()


def dealt(rows: DataFrame, n: int, column: str, by: int = 1) -> DataFrame:
    """rows (with _i, n of them) with the column's value of the row `by` places on, past the end from the start."""
    by = 1 + (by - 1) % max(1, n - 1)  # never a row's own, unless it is the only one
    from_there = rows.select(F.pmod(F.col("_i") - by, F.lit(max(1, n))).alias("_i"), F.col(column).alias("_v"))
    return rows.join(from_there, "_i").withColumn(column, F.col("_v")).drop("_v")


def permuted(test: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """test with the column's values dealt anew, each to another row (a lone row keeps its own).

    In the order of the keys' hash, which is as good as random, each row gets the value of the next one and the last that of
    the first, by a join on places.
    """
    return dealt(*numbered(test, key, seed), column).select(*test.columns)


def permutation_importance(model, test: DataFrame, features: list[str], key: str, score, seed: int = 0) -> list[tuple[str, float]]:
    """Loss of score(model.transform(.)) when a feature's values are dealt anew. Rows are put in random order and written once for all features."""
    rows, n = numbered(test, key, seed)
    base = score(model.transform(rows))
    return [(f, base - score(model.transform(dealt(rows, n, f, 1 + k)))) for k, f in enumerate(features)]
