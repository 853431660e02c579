"""Crisis events, validators and bootstrap (E1-E19). Event tables are fixed dimensions of a few rows, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import band, normal_cdf, with_month
from ..functions.scan import carried, in_reach, own_rows, reach_window, segment_starts


def period_rates(labels: DataFrame, events: DataFrame, before: str = "30 days", gap: str = "7 days", after: str = "21 days") -> DataFrame:
    """Percent of stress before, in and after each event (name, onset, crisis_end), half-open."""
    pre, lo, hi = (F.expr(f"interval {x}") for x in (before, gap, after))
    t, on, end = F.col("time"), F.col("onset"), F.col("crisis_end")
    period = F.when((t >= on) & (t < end), "crisis").when((t >= on - pre) & (t < on), "pre").when((t >= end + lo) & (t < end + hi), "post")
    j = labels.join(F.broadcast(events), (t >= on - pre) & (t < end + hi)).withColumn("period", period).where("period is not null")
    return j.groupBy("name", "asset", "period").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == 2).cast("double")).alias("rate"))


def proportion_z_test(df: DataFrame, p1: str = "p1", n1: str = "n1", p2: str = "p2", n2: str = "n2") -> DataFrame:
    """Pooled z, two-sided p, significant below 0.01; null where it is not defined."""
    a, m, b, n = map(F.col, (p1, n1, p2, n2))
    pool = F.when((m > 0) & (n > 0), (a * m + b * n) / (m + n))
    se = F.sqrt(F.greatest(F.lit(0.0), pool * (1 - pool) * (F.lit(1.0) / F.when(m > 0, m) + F.lit(1.0) / F.when(n > 0, n))))
    z = F.when(se > 0, (a - b) / se)
    return df.withColumn("z", z).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z")))).withColumn("significant", F.col("p_value") < 0.01)


def simultaneous_stress(labels: DataFrame, assets: int) -> DataFrame:
    """Percent of times, at which all assets are there, when all or any are in stress."""
    s = (F.col("label") == 2).cast("int")
    t = labels.groupBy("time").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") == assets)
    return t.agg(F.count(F.lit(1)).alias("n"), (F.avg("lo") * 100).alias("pct_all"), (F.avg("hi") * 100).alias("pct_any"))


def cohens_kappa(pairs: DataFrame, *keys: str, a: str = "a", b: str = "b") -> DataFrame:
    """Of 0/1 columns; 0 where agreement by chance is sure."""
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    s = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), (x * y + (1 - x) * (1 - y)).alias("pe"))
    return s.select(*keys, "n", (F.col("po") * 100).alias("agreement"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(0.0).alias("kappa"))


def kappa_band(kappa):
    """E5: Landis and Koch."""
    return F.when(kappa < 0, "poor").otherwise(F.when(kappa <= 0.20, "slight").when(kappa <= 0.40, "fair").when(kappa <= 0.60, "moderate").when(kappa <= 0.80, "substantial").otherwise("almost perfect"))


def drawdown(prices: DataFrame, n: int = 12, width: float = 10) -> DataFrame:
    """Percent below the highest of this price and the n before; prices that aren't positive and finite are carried over.
    A gap longer than a bar (width: its seconds) ends what is looked back on and carried."""
    begins = segment_starts(prices, width)
    ok = F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.struct("time", "price"))
    x = carried(begins, {"_start": F.when(F.col("_begins"), F.col("time")), "_held": ok})
    x = x.withColumn("price", F.when(F.col("_held.time") >= F.col("_start"), F.col("_held.price")))
    x = in_reach(x.drop("_begins", "_start", "_held"), n, width)
    peak = F.max("price").over(reach_window().rowsBetween(-n, 0))
    return own_rows(x.withColumn("drawdown", (peak - F.col("price")) / peak * 100))


def drawdown_flag(table: DataFrame, baseline: DataFrame, p: float = 0.95) -> DataFrame:
    """Above the percentile of the baseline rows, by asset."""
    bound = baseline.groupBy("asset").agg(F.percentile("drawdown", p).alias("bound"))
    return table.join(F.broadcast(bound), "asset").withColumn("flag", (F.col("drawdown") > F.col("bound")).cast("int")).drop("bound")


def event_window_flag(df: DataFrame, events: DataFrame) -> DataFrame:
    """1 where time is in any event's [onset, crisis_end]."""
    hit = F.broadcast(events.select("onset", "crisis_end"))
    inside = df.select("time").distinct().join(hit, F.col("time").between(F.col("onset"), F.col("crisis_end"))).select("time").distinct().withColumn("in_event", F.lit(1))
    return df.join(inside, "time", "left").withColumn("in_event", F.coalesce("in_event", F.lit(0)))


def validator_kappa(stacked: DataFrame) -> DataFrame:
    """Rows (fold, asset, hmm_type, validator, a, b)."""
    return cohens_kappa(stacked, "fold", "asset", "hmm_type", "validator")


def any_other_stress(labels: DataFrame, exclude_self: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether any (other) asset is in stress at the time, within the keys."""
    s = (F.col("label") == 2).cast("int")
    n = F.sum(s).over(Window.partitionBy(*keys, "time"))
    return labels.withColumn("others", ((n - s if exclude_self else n) > 0).cast("int"))


VALIDATORS = ("drawdown", "timestamp", "cross_asset")


def validators(labels: DataFrame, drawdowns: DataFrame, events: DataFrame, folds: DataFrame, p: float = 0.95) -> DataFrame:
    """Rows (fold, asset, hmm_type, validator, a, b) of the labels (fold, hmm_type, asset, time, label) of test windows.

    a: stress by the label. b: a drawdown (asset, time, drawdown) above the percentile of those before the fold's window; a time
    in an event; or stress in another asset by labels of the same kind. folds (fold, start) and events have few rows.
    """
    before = drawdowns.join(F.broadcast(folds), F.col("time") < F.col("start"))
    bounds = before.groupBy("fold", "asset").agg(F.percentile("drawdown", p).alias("bound"))
    x = any_other_stress(labels, keys=("fold", "hmm_type")).withColumnRenamed("others", "cross_asset").withColumn("a", (F.col("label") == 2).cast("int"))
    x = event_window_flag(x, events).withColumnRenamed("in_event", "timestamp")
    x = x.join(drawdowns.select("asset", "time", "drawdown"), ["asset", "time"]).join(F.broadcast(bounds), ["fold", "asset"])  # a row a fold and asset
    x = x.withColumn("drawdown", (F.col("drawdown") > F.col("bound")).cast("int"))
    return x.select("fold", "asset", "hmm_type", "a", *VALIDATORS).unpivot(["fold", "asset", "hmm_type", "a"], list(VALIDATORS), "validator", "b")


def kappa_matrix(kappas: DataFrame, validators: tuple[str, ...] = VALIDATORS) -> DataFrame:
    """The mean kappa over assets, by fold and kind of label, a column a validator."""
    return kappas.groupBy("fold", "hmm_type").pivot("validator", list(validators)).agg(F.avg("kappa"))


def exclude_windows(df: DataFrame, events: DataFrame, margin: str = "14 days") -> DataFrame:
    """E11."""
    m = F.expr(f"interval {margin}")
    return df.join(F.broadcast(events.select("onset", "crisis_end")), (F.col("time") >= F.col("onset") - m) & (F.col("time") <= F.col("crisis_end") + m), "left_anti")


def label_runs(labels: DataFrame, width_s: float) -> DataFrame:
    """Runs of equal labels, broken by gaps longer than a bar: asset, label, start, end, length, mean_price (if there are prices)."""
    x = in_reach(labels, 1, width_s)
    before = F.lag("label").over(reach_window())
    x = own_rows(x.withColumn("_new", before.isNull() | (before != F.col("label"))))
    x = carried(x, {"start": F.when(F.col("_new"), F.col("time"))})
    return x.groupBy("asset", "start", "label").agg(F.max("time").alias("end"), F.count(F.lit(1)).alias("length"), *([F.avg("price").alias("mean_price")] if "price" in labels.columns else []))


def stress_runs(labels: DataFrame, width_s: float, least: int = 12, top: int = 5) -> DataFrame:
    """The longest runs of stress of each asset."""
    r = label_runs(labels, width_s).where((F.col("label") == 2) & (F.col("length") >= least))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("length"), "start"))).where(F.col("rank") <= top).drop("label")


def period_pivot(rates: DataFrame, value: str = "rate") -> DataFrame:
    """E13."""
    return rates.groupBy("asset").pivot("period", ["pre", "crisis", "post"]).agg(F.avg(value))


def first_sustained(probs: DataFrame, *keys: str, above: float = 0.85, k: int = 2) -> DataFrame:
    """By key, the first time of k consecutive probabilities above the bound."""
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(0, k - 1)
    x = probs.withColumns({"lo": F.min("prob").over(w), "n": F.count("prob").over(w)})
    return x.where((F.col("lo") > above) & (F.col("n") == k)).groupBy(*keys).agg(F.min("time").alias("signal"))


def lead_time(probs: DataFrame, events: DataFrame, above: float = 0.85, k: int = 2) -> DataFrame:
    """For each event (name, asset, reference, lookback_hours) the minutes from the first sustained signal to the reference."""
    back = F.make_interval(hours=F.col("lookback_hours"))
    e = events.select("name", "asset", "reference", (F.col("reference") - back).alias("since"))
    j = F.broadcast(e).join(probs, "asset").where((F.col("time") >= F.col("since")) & (F.col("time") <= F.col("reference")))
    seen = j.groupBy("name", "asset").agg(F.count(F.lit(1)).alias("rows"), F.max("prob").alias("max_prob"))
    first = first_sustained(j, "name", "asset", above=above, k=k)
    out = e.join(seen, ["name", "asset"], "left").join(first, ["name", "asset"], "left")
    minutes = (F.unix_micros(F.col("reference").cast("timestamp")) - F.unix_micros(F.col("signal").cast("timestamp"))) / 60_000_000
    status = F.when(F.col("rows").isNull(), "NO_DATA").when(F.col("signal").isNull(), "NO_SIGNAL").otherwise("OK")
    return out.select("name", "asset", "reference", "signal", minutes.alias("lead_minutes"), "max_prob", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def drawdown_onset(prices: DataFrame, events: DataFrame, hours: int = 6, drop: float = 0.05) -> DataFrame:
    """In the lookback of each event, the first time the price is `drop` below the peak of the hours before it."""
    w = Window.partitionBy("asset").orderBy("us").rangeBetween(-hours * 3_600_000_000, -1)
    x = prices.withColumn("us", F.unix_micros(F.col("time").cast("timestamp"))).withColumn("peak", F.max("price").over(w))
    hit = x.where(F.col("price") <= F.col("peak") * (1 - drop))
    e = events.select("name", "asset", "reference", (F.col("reference") - F.make_interval(hours=F.col("lookback_hours"))).alias("since"))
    j = F.broadcast(e).join(hit, "asset").where((F.col("time") >= F.col("since")) & (F.col("time") <= F.col("reference")))
    return j.groupBy("name", "asset").agg(F.min("time").alias("drawdown_onset"))


def lead_time_multi_ref(probs: DataFrame, prices: DataFrame, events: DataFrame, **how) -> DataFrame:
    """Lead times to the HMM onset, the external time, and the drawdown onset of events (name, asset, hmm_onset, external, lookback_hours)."""
    base = events.withColumn("reference", F.col("external"))
    found = drawdown_onset(prices, base)
    priced = prices.select("asset").distinct().withColumn("priced", F.lit(True))
    refs = events.join(found, ["name", "asset"], "left").join(priced, "asset", "left")
    out = None
    for kind in ("hmm_onset", "external", "drawdown_onset"):
        one = lead_time(probs, refs.where(F.col(kind).isNotNull()).select("name", "asset", F.col(kind).alias("reference"), "lookback_hours"), **how).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    none = refs.where("drawdown_onset is null").select("name", "asset", F.lit(None).cast("timestamp").alias("reference"), F.lit(None).cast("timestamp").alias("signal"), F.lit(None).cast("double").alias("lead_minutes"), F.lit(None).cast("double").alias("max_prob"), F.lit(0).alias("rows"), F.when(F.col("priced").isNull(), "NO_PRICE_DATA").otherwise("NO_DRAWDOWN_IN_WINDOW").alias("status"), F.lit("drawdown_onset").alias("kind"))
    return out.unionByName(none)


def lead_summary(leads: DataFrame, *keys: str) -> DataFrame:
    """E18."""
    ok = leads.where("status = 'OK'")
    s = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("lead_minutes").alias("mean"), F.median("lead_minutes").alias("median"), F.min("lead_minutes").alias("min"), F.max("lead_minutes").alias("max"))
    return s.withColumn("band", band(F.col("median"), [(30, "STRONG"), (15, "USEFUL"), (5, "MARGINAL")], "NONE"))


def block_bootstrap(series: DataFrame, targets: DataFrame, block: int, reps: int = 10_000, seed: int = 1, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Circular block bootstrap of the 0/1 column `flag` of each key's series (keys, time, flag).

    targets has a row a key with n_sample, the length of a replicate (that of the window it is compared with), and observed,
    the rate there. A replicate is ceil(n_sample / block) blocks, the last one cut. A start is the MD5 of (keys, replicate,
    block, seed), modulo the length of the series. Gives n_pre, n_sample, pre_rate, observed, null_mean, lo and hi (2.5 and
    97.5 percentiles) and p_value, the share of replicates not below observed, at least 1 / reps.

    Block sums come from prefix sums by two equi-joins, so a replicate costs its blocks, not its rows. Rows are numbered
    within months; the months' offsets come from a small table.
    """
    x = with_month(series.select(*keys, "time", F.col("flag").cast("long").alias("flag")))
    months = x.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("rows"), F.sum("flag").alias("ones"))
    before = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    months = months.select(*keys, "month", *(F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in ("rows", "ones")))
    w = Window.partitionBy(*keys, "month").orderBy("time")
    x = x.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "s": F.coalesce(F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)})
    x = x.join(months, [*keys, "month"]).select(*keys, (F.col("i") + F.col("rows_before")).alias("i"), (F.col("s") + F.col("ones_before")).alias("s"))
    whole = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pre"), F.sum(F.col("flag").cast("long")).alias("total"))
    t = whole.join(targets.select(*keys, F.col("n_sample").cast("long").alias("n_sample"), "observed"), list(keys)).where("n_pre > 0 AND n_sample > 0")
    draws = t.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_sample") + block - 1) / block) - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws("/", *keys, "rep", "k", F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long") % F.col("n_pre")
    draws = draws.withColumns({"a": start, "len": F.least(F.lit(block).cast("long"), F.col("n_sample") - block * F.col("k"))})
    draws = draws.withColumns({"z": (F.col("a") + F.col("len")) % F.col("n_pre"), "turns": F.floor((F.col("a") + F.col("len")) / F.col("n_pre"))})
    j = draws.join(x.select(*keys, F.col("i").alias("a"), F.col("s").alias("s_a")), [*keys, "a"]).join(x.select(*keys, F.col("i").alias("z"), F.col("s").alias("s_z")), [*keys, "z"])
    rates = j.groupBy(*keys, "rep", "n_pre", "n_sample", "total", "observed").agg(F.sum(F.col("s_z") + F.col("turns") * F.col("total") - F.col("s_a")).alias("ones")).withColumn("rate", F.col("ones") / F.col("n_sample").cast("double"))
    p = F.greatest(F.avg((F.col("rate") >= F.col("observed")).cast("double")), F.lit(1.0 / reps))
    # a key has `reps` rates
    out = rates.groupBy(*keys, "n_pre", "n_sample", "total", "observed").agg(F.avg("rate").alias("null_mean"), F.percentile("rate", 0.025).alias("lo"), F.percentile("rate", 0.975).alias("hi"), p.alias("p_value"))
    return out.select(*keys, "n_pre", "n_sample", (F.col("total") / F.col("n_pre")).alias("pre_rate"), "observed", "null_mean", "lo", "hi", "p_value", (F.col("p_value") < 0.05).alias("significant"))


def bootstrap_test(labels: DataFrame, events: DataFrame, block: int, reps: int = 10_000, seed: int = 1, before: str = "30 days") -> DataFrame:
    """For each event (name, onset, crisis_end; half-open) and asset, its rate of stress against blocks from `before` its onset."""
    stress = (F.col("label") == 2).cast("int")
    t, on = F.col("time"), F.col("onset")
    j = labels.join(F.broadcast(events), (t >= on - F.expr(f"interval {before}")) & (t < F.col("crisis_end")))
    targets = j.where(t >= on).groupBy("name", "asset").agg(F.count(F.lit(1)).alias("n_sample"), F.avg(stress.cast("double")).alias("observed"))
    return block_bootstrap(j.where(t < on).select("name", "asset", "time", stress.alias("flag")), targets, block, reps, seed, ("name", "asset"))
