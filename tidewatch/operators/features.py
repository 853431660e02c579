"""Rolling microstructure features of bars.

Frames are of rows of one segment (an asset's month), so a frame never holds bars from before a gap between months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, SEGMENT, clip, rolling, safe_corr, when_full, with_month
from .bars import bar_deltas, bars, densify

SCALES = (1, 6, 30)
CONTAGION = (("BTC", "ETH"), ("BTC", "SOL"), ("ETH", "SOL"))


def rolling_features(dense: DataFrame, seconds: int = 10, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """F1-F9 of dense bars with deltas. A column of scale w is named by its seconds; it is null until w bars are there, Kyle's lambda 0."""
    dense, out = with_month(dense), {}
    for w in scales:
        f, name = rolling(w, *SEGMENT), f"{w * seconds}s"
        s = {c: F.sum(c).over(f) for c in ("v_buy", "v_sell", "n_buy", "n_sell", "volume", "quote", "abs_r")}
        full = lambda x, f=f, w=w: when_full(x, f, w)
        vwap = s["quote"] / (s["volume"] + EPS)
        out[f"OFI_{name}"] = full((s["v_buy"] - s["v_sell"]) / (s["v_buy"] + s["v_sell"] + EPS))
        out[f"TCI_{name}"] = full((s["n_buy"] - s["n_sell"]) / (s["n_buy"] + s["n_sell"] + EPS))
        out[f"intensity_{name}"] = full((s["n_buy"] + s["n_sell"]) / (w * seconds))
        out[f"VWAP_{name}"] = full(vwap)
        out[f"VWAP_dev_{name}"] = full((F.col("price") - vwap) / (vwap + EPS))
        out[f"ILLIQ_{name}"] = full(s["abs_r"] / (s["volume"] + EPS))
        out[f"RV_{name}"] = full(F.sqrt(F.sum(F.col("rv") * F.col("rv")).over(f)))
        if w > 1:
            sp, sv = F.stddev_samp("dp").over(f), F.stddev_samp("sv").over(f)
            out[f"Kyle_lambda_{name}"] = F.coalesce(full(safe_corr(F.col("dp"), F.col("sv"), f) * sp / (sv + EPS)), F.lit(0.0))
    out[f"CV_dt_{seconds}s"] = F.coalesce(F.col("std_dt") / (F.col("mean_dt") + EPS), F.lit(0.0))
    return dense.withColumns(out)


def feature_table(trades: DataFrame, seconds: int = 10, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """bars, grid, deltas and features; intermediates are dropped."""
    width = f"{seconds} seconds"
    wide = rolling_features(bar_deltas(densify(bars(trades, width), width)), seconds, scales)
    return wide.drop("v_buy", "v_sell", "n_buy", "n_sell", "quote", "abs_r", "mean_dt", "std_dt", "dp", "sv")


def contagion(features: DataFrame, target: str, lead: str, short: str = "OFI_60s", long: str = "OFI_300s") -> DataFrame:
    """target's rows with rolling correlations to the lead asset over 6 and 30 bars, and over 6 to the lead one bar before."""
    x = features.where(F.col("asset") == target)
    y = features.where(F.col("asset") == lead).select("time", F.col(short).alias("lead_short"), F.col(long).alias("lead_long"))
    j = x.join(y, "time", "left")
    before = F.lag("lead_short").over(Window.partitionBy(*SEGMENT).orderBy("time"))
    j = with_month(j).withColumn("lead_before", before)
    f6, f30 = rolling(6, *SEGMENT), rolling(30, *SEGMENT)
    corr = lambda a, b, f, n: F.coalesce(F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(f) == n, safe_corr(F.col(a), F.col(b), f)), F.lit(0.0))
    made = {f"OFI_corr_60s_{lead}": corr(short, "lead_short", f6, 6), f"OFI_corr_300s_{lead}": corr(long, "lead_long", f30, 30), f"Lead_Lag_60s_{lead}": corr(short, "lead_before", f6, 6)}
    return j.withColumns(made).drop("lead_short", "lead_long", "lead_before")


def contagion_plan(features: DataFrame, plan: tuple[tuple[str, str], ...] = CONTAGION, **columns: str) -> dict[str, DataFrame]:
    """for each target the table with the columns of all its leads."""
    out: dict[str, DataFrame] = {}
    for lead, target in plan:
        out[target] = contagion(out.get(target, features), target, lead, **columns) if target not in out else _with_lead(out[target], features, target, lead, columns)
    return out


def _with_lead(done: DataFrame, features: DataFrame, target: str, lead: str, columns: dict) -> DataFrame:
    more = contagion(features, target, lead, **columns)
    return done.join(more.select("asset", "time", *(c for c in more.columns if c.endswith(f"_{lead}"))), ["asset", "time"])


def live_names(scales: tuple[int, ...] = (10, 60, 300)) -> list[str]:
    """The 26 features that the live path and the table of bars both have (with three scales)."""
    by_scale = [f"{c}_{s}s" for s in scales for c in ("OFI", "TCI", "intensity", "VWAP", "VWAP_dev", "ILLIQ", "RV")]
    return ["price", "volume", "rv", *by_scale, *(f"Kyle_lambda_{s}s" for s in scales[1:])]


def with_returns(trades: DataFrame, chunk_s: int = 600) -> DataFrame:
    """Adds us, lp and r, the clipped return that arrives at a trade, 0 at the first of a segment.

    Trades are ordered within chunks of a segment; the return into a chunk comes from the small table of chunks.
    """
    t = with_month(trades).withColumns({"us": F.unix_micros(F.col("time").cast("timestamp")), "lp": F.log("price")})
    t = t.withColumn("chunk", F.floor(F.col("us") / (chunk_s * 1_000_000)))
    t = t.withColumn("before", F.lag("lp").over(Window.partitionBy(*SEGMENT, "chunk").orderBy("us", "id")))
    ends = t.groupBy(*SEGMENT, "chunk").agg(F.max_by("lp", F.struct("us", "id")).alias("last"))
    ends = ends.select(*SEGMENT, "chunk", F.lag("last").over(Window.partitionBy(*SEGMENT).orderBy("chunk")).alias("carry"))
    t = t.join(ends, [*SEGMENT, "chunk"])
    r = F.coalesce(clip(F.col("lp") - F.coalesce("before", "carry"), -0.5, 0.5), F.lit(0.0))
    return t.withColumn("r", r).drop("chunk", "before", "carry")


def bars_before(trades: DataFrame, anchors: DataFrame, bar: int, n: int) -> DataFrame:
    """asset, time, k, end and the trades of each of the n bars (end - bar, end] that end at an anchor (asset, time, z), k from 0.

    Bars' ends are put among the trades, in cells of a bar's width that don't depend on the anchors: at an end stands what its
    cell has up to there and what comes after. A bar is what comes after its start and what its end's cell has up to that.
    Trades are read once, and not copied to anchors; nothing is subtracted. What lies on the very end is summed apart too,
    since a window that starts there holds it.
    """
    step, kinds = bar * 1_000_000, _kinds()
    t = with_returns(trades, 2 * n * bar).select("asset", "us", "id", F.struct("us", "price").alias("tick"), *(x.alias(c) for c, x in kinds.items()))
    ends = anchors.select("asset", "time", "z", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("k")).withColumn("us", F.col("z") - (n - 1 - F.col("k")) * step)
    x = t.unionByName(ends, allowMissingColumns=True).withColumns({"cell": F.col("us") - F.pmod("us", F.lit(step)), "is_end": F.col("tick").isNull()})
    cell, order = Window.partitionBy("asset", "cell"), ("us", "is_end", "id")
    rows = (Window.unboundedPreceding, Window.currentRow)
    head, tail = cell.orderBy(*order).rowsBetween(*rows), cell.orderBy(*(F.desc(c) for c in order)).rowsBetween(*rows)
    on_end, before = cell.orderBy("us").rangeBetween(0, 0), cell.orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    gap = F.when(~F.col("is_end"), F.col("us") - F.last("tick.us", ignorenulls=True).over(cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumns({"gap2": gap.cast("decimal(19, 0)") * gap.cast("decimal(19, 0)"), "sv": F.col("v_buy") - F.col("v_sell")})
    nothing, no_gap = F.lit(0.0), F.lit(0).cast("decimal(38, 0)")
    made = {}
    for side, over in (("head", head), ("tail", tail)):
        made |= {f"{side}_{c}": F.coalesce(F.sum(c).over(over), nothing) for c in (*kinds, "sv")}
        made |= {f"{side}_n": F.count("tick").over(over), f"{side}_ss": F.coalesce(F.sum("gap2").over(over), no_gap)}
        made |= {f"{side}_near": F.last("tick", ignorenulls=True).over(over), f"{side}_far": F.first("tick", ignorenulls=True).over(over)}
    made |= {f"edge_{c}": F.coalesce(F.sum(c).over(on_end), nothing) for c in kinds} | {"n_edge": F.count("tick").over(on_end), "before_edge": F.max("tick.us").over(before)}
    x = x.withColumns(made).where("is_end")
    # the gap into a tail's first trade starts before the tail
    across = (F.col("tail_near.us") - F.col("head_near.us")).cast("decimal(19, 0)")
    x = x.withColumn("tail_ss", F.col("tail_ss") - F.coalesce(across * across, F.lit(0)))
    back = Window.partitionBy("asset", "time").orderBy("k")
    came = lambda c: F.lag(f"tail_{c}").over(back)
    x = x.withColumns({f"came_{c}": came(c) for c in (*kinds, "sv", "n", "ss", "near", "far")}).where("k >= 0")
    joint = (F.col("head_far.us") - F.col("came_far.us")).cast("decimal(19, 0)")
    first, last = F.coalesce("came_near", "head_far"), F.coalesce("head_near", "came_far")
    return x.select(
        "asset", "time", "k", F.col("us").alias("end"), "n_edge", F.coalesce("before_edge", "came_far.us").alias("before_edge"), (F.col("came_n") + F.col("head_n")).alias("n"),
        first["us"].alias("u0"), last["us"].alias("u1"), first["price"].alias("first"), last["price"].alias("last"), (F.col("came_ss") + F.col("head_ss") + F.coalesce(joint * joint, F.lit(0))).alias("ss_gap"),
        *((F.col(f"came_{c}") + F.col(f"head_{c}")).alias(c) for c in (*kinds, "sv")), *(f"edge_{c}" for c in kinds),
    )


def _kinds() -> dict:
    """What is summed of trades."""
    sell, one, none = F.col("is_buyer_maker"), F.lit(1.0), F.lit(0.0)
    flows = {"v_buy": F.when(~sell, F.col("qty")).otherwise(none), "v_sell": F.when(sell, F.col("qty")).otherwise(none), "n_buy": F.when(~sell, one).otherwise(none), "n_sell": F.when(sell, one).otherwise(none)}
    return flows | {"volume": F.col("qty"), "quote": F.col("quote_qty"), "abs_r": F.abs("r"), "rr": F.col("r") * F.col("r")}


def features_at(trades: DataFrame, anchors: DataFrame, scales: tuple[int, ...] = (10, 60, 300)) -> DataFrame:
    """all live features at each anchor (asset, time), from the trades in [t - s, t] of each scale s (seconds, multiples of the first).

    What is looked at reaches one shortest scale further back than the longest, as a live fetch does; a scale with fewer than
    two trades takes all of that. Kyle's lambda comes from bars of the shortest scale that end at the anchor, the gaps'
    deviation (CV_dt) from the shortest scale. All sums are of the bars that end at the anchor (bars_before), so no trade is
    copied to the fetches that hold it. An anchor without trades gives no row.
    """
    if any(s % scales[0] for s in scales):
        raise ValueError("scales must be multiples of the first")
    bar, span = scales[0], scales[-1] + scales[0]
    n = span // bar
    a = anchors.select("asset", "time", F.unix_micros(F.col("time").cast("timestamp")).alias("z")).distinct()
    grid = bars_before(trades, a, bar, n)
    over = Window.partitionBy("asset", "time").orderBy("k")
    carried = F.coalesce(F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.first("first", ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing)))
    grid = grid.withColumns({"p": carried, "earlier": F.max("u1").over(over.rowsBetween(Window.unboundedPreceding, -1))})
    # the gap into the last cell, and the one into what lies on the end of the cell before it, from whatever came before in the fetch
    k, edges = F.col("k"), (F.col("k") == n - 2) & (F.col("n_edge") > 0)
    into = F.when(k == n - 1, F.col("u0") - F.col("earlier")).when(edges, F.col("end") - F.coalesce("before_edge", "earlier")).cast("decimal(19, 0)")
    grid = grid.withColumns({"dp": F.col("p") - F.lag("p").over(over), "into": into})
    within = lambda x: F.when(k == n - 1, x)

    m = {s: s // bar for s in scales}
    part = lambda c, s: F.when(k >= n - m[s], F.col(c)).when(k == n - m[s] - 1, F.col(f"edge_{c}"))
    sums = [F.sum(c).alias(f"all_{c}") for c in _kinds()] + [F.coalesce(F.sum(part(c, s)), F.lit(0.0)).alias(f"{s}_{c}") for s in scales for c in _kinds()]
    gaps = [
        F.sum(F.coalesce(within(F.greatest(F.col("n") - 1, F.lit(0))), F.when(edges, F.col("n_edge") - 1), F.lit(0)) + F.col("into").isNotNull().cast("long")).alias("n_dt"),
        F.sum(F.coalesce(within(F.col("u1") - F.col("u0")), F.lit(0)) + F.coalesce("into", F.lit(0))).alias("s_dt"), F.sum(F.coalesce(within(F.col("ss_gap")), F.lit(0)) + F.coalesce(F.col("into") * F.col("into"), F.lit(0))).alias("ss_dt"),
    ]
    lambdas = []
    for s in scales[1:]:
        dp, sv = F.when(k >= n - m[s], F.col("dp")), F.when(k >= n - m[s], F.col("sv"))
        sp, ss = F.stddev_samp(dp), F.stddev_samp(sv)
        lambdas.append(F.coalesce(F.when((sp > 1e-12) & (ss > 1e-12), F.covar_samp(dp, sv) / (sp * ss) * sp / (ss + EPS)), F.lit(0.0)).alias(f"Kyle_lambda_{s}s"))
    w = grid.groupBy("asset", "time").agg(F.sum("n").alias("n_trades"), F.max_by("last", F.when(F.col("last").isNotNull(), k)).alias("price"), *sums, *gaps, *lambdas).where("n_trades > 0")
    out = {}
    for s in scales:
        enough = F.col(f"{s}_n_buy") + F.col(f"{s}_n_sell") >= 2
        x = {c: F.when(enough, F.col(f"{s}_{c}")).otherwise(F.col(f"all_{c}")) for c in _kinds()}
        vwap = x["quote"] / (x["volume"] + EPS)
        out |= {
            f"OFI_{s}s": (x["v_buy"] - x["v_sell"]) / (x["v_buy"] + x["v_sell"] + EPS), f"TCI_{s}s": (x["n_buy"] - x["n_sell"]) / (x["n_buy"] + x["n_sell"] + EPS),
            f"intensity_{s}s": (x["n_buy"] + x["n_sell"]) / F.lit(float(s)), f"VWAP_{s}s": vwap, f"VWAP_dev_{s}s": (F.col("price") - vwap) / (vwap + EPS),
            f"ILLIQ_{s}s": x["abs_r"] / (x["volume"] + EPS), f"RV_{s}s": F.sqrt(x["rr"]),
        }
        if s == bar:
            out |= {"volume": x["volume"], "rv": out[f"RV_{s}s"]}
    # gaps are whole microseconds, so equal ones have no deviation at all
    squares = (F.col("n_dt").cast("decimal(19, 0)") * F.col("ss_dt") - F.col("s_dt") * F.col("s_dt")).cast("double")
    deviation = F.sqrt(squares / (F.col("n_dt").cast("double") * (F.col("n_dt") - 1)))
    out[f"CV_dt_{bar}s"] = F.when(F.col("n_dt") > 1, deviation / (F.col("s_dt").cast("double") / F.col("n_dt") + EPS)).otherwise(0.0)
    return w.withColumns(out).select("asset", "time", "n_trades", *live_names(scales), f"CV_dt_{bar}s")


def anchored_bars(trades: DataFrame, anchors: DataFrame, n: int = 31, seconds: int = 10) -> DataFrame:
    """n buckets (start, end] that end at each anchor (asset, time), empty ones with flow 0."""
    step = seconds * 1_000_000
    a = anchors.select("asset", F.col("time").alias("anchor"), F.unix_micros(F.col("time").cast("timestamp")).alias("z")).distinct()
    grid = a.select("asset", "anchor", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    t = trades.select("asset", "id", "price", "qty", "is_buyer_maker", F.unix_micros(F.col("time").cast("timestamp")).alias("us"))
    span = n * step
    t = t.withColumn("b", F.floor(F.col("us") / span))
    b = a.withColumn("b", F.explode(F.array(F.floor((F.col("z") - span) / span), F.floor(F.col("z") / span)))).distinct()
    j = b.join(t, ["asset", "b"]).where((F.col("us") > F.col("z") - span) & (F.col("us") <= F.col("z")))
    k = F.floor((F.col("us") - (F.col("z") - span) - 1) / step).cast("int")
    sums = j.groupBy("asset", "anchor", k.alias("k")).agg(F.sum(F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)).alias("v_buy"), F.sum(F.when(F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)).alias("v_sell"), F.max_by("price", F.struct("us", "id")).alias("price"))
    w = Window.partitionBy("asset", "anchor").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(sums, ["asset", "anchor", "k"], "left").select("asset", "anchor", "k", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("v_buy", "v_sell")), F.last("price", ignorenulls=True).over(w).alias("price"))
