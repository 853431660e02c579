"""Regime labels: distributed hidden Markov model and what is read off its labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import with_month
from ..functions.scan import in_reach, own_rows, reach_window
from .transform import nan_to_num

FEATURES = ("RV_300s", "OFI_300s", "Kyle_lambda_300s", "intensity_300s")


class Hmm:
    """Gaussian, diagonal. means and variances (k, f); transition (k, k); start (k)."""

    def __init__(self, means, variances, transition, start, score=float("-inf")):
        self.means, self.variances, self.transition, self.start, self.score = means, variances, transition, start, score

    def emission(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means
        return -0.5 * (d * d / self.variances + np.log(2 * np.pi * self.variances)).sum(axis=2)


def _in_blocks(steps: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Matrices (n, ...) as (blocks, rows, ...) of about as many blocks as rows, filled up with `one`."""
    n = len(steps)
    rows = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // rows)
    fill = np.broadcast_to(one, (blocks * rows - n, *steps.shape[1:]))
    return np.concatenate([steps, fill]).reshape(blocks, rows, *steps.shape[1:])


def _products(blocks: np.ndarray) -> np.ndarray:
    """The product of each block's matrices, scaled."""
    now = blocks[:, 0]
    for l in range(1, blocks.shape[1]):
        now = now @ blocks[:, l]
        now = now / np.maximum(now.max(axis=(-1, -2), keepdims=True), 1e-300)
    return now


def _product(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of matrices (n, s, k, k) in order, scaled, and the logarithm of its scale: pairs of neighbours, then pairs of those."""
    logs = np.zeros(steps.shape[:2])
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps, np.broadcast_to(np.eye(steps.shape[-1]), (1, *steps.shape[1:]))])
            logs = np.concatenate([logs, np.zeros((1, logs.shape[1]))])
        steps, logs = steps[0::2] @ steps[1::2], logs[0::2] + logs[1::2]
        scale = np.maximum(steps.max(axis=(-1, -2)), 1e-300)
        steps, logs = steps / scale[..., None, None], logs + np.log(scale)
    return steps[0], logs[0]


def _carried(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row vectors (n, s, k): each the one before times its matrix, scaled to 1. A loop over blocks and one within all blocks at once."""
    blocks = _in_blocks(steps, np.eye(steps.shape[-1]))
    starts, now = [], first
    for m in _products(blocks):
        starts.append(now)
        now = (now[:, None, :] @ m)[:, 0]
        now = now / np.maximum(now.sum(axis=-1, keepdims=True), 1e-300)
    out, now = np.empty(blocks.shape[:-1]), np.stack(starts)
    for l in range(blocks.shape[1]):
        now = (now[:, :, None, :] @ blocks[:, l])[:, :, 0]
        now = now / np.maximum(now.sum(axis=-1, keepdims=True), 1e-300)
        out[:, l] = now
    return out.reshape(-1, *out.shape[2:])[: len(steps)]


def _steps(models: list[Hmm], x: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of each row for each model, from the states of the row before (any, for the first of a segment) to its own, and the logarithm of their scale."""
    e = np.stack([m.emission(x) for m in models], axis=1)
    top = e.max(axis=2, keepdims=True)
    p = np.exp(e - top)
    out = np.stack([m.transition for m in models]) * p[:, :, None, :]
    if first:
        out[0] = (np.stack([m.start for m in models]) * p[0])[:, None, :]
    return out, top.sum(axis=(0, 2))


def _summary(models: list[Hmm], x: np.ndarray, first: bool) -> np.ndarray:
    """What a chunk does to the states before it: its product (k * k numbers a model) and scale."""
    steps, top = _steps(models, x, first)
    product, logs = _product(steps)
    return np.concatenate([product.reshape(len(models), -1), (logs + top)[:, None]], axis=1)


def _carry(summaries: np.ndarray, k: int) -> np.ndarray:
    """For each chunk of a segment (c, s, k * k + 1): forward states before it, backward states after it, and its share of the log-likelihood."""
    c, s = summaries.shape[:2]
    m, logs = summaries[:, :, :-1].reshape(c, s, k, k), summaries[:, :, -1]
    out = np.empty((c, s, 2 * k + 1))
    now = np.full((s, k), 1 / k)
    for i in range(c):
        out[i, :, :k] = now
        now = (now[:, None, :] @ m[i])[:, 0]
        total = np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
        out[i, :, -1], now = np.log(total[:, 0]) + logs[i], now / total
    now = np.ones((s, k))
    for i in range(c - 1, -1, -1):
        out[i, :, k : 2 * k] = now
        now = (m[i] @ now[:, :, None])[:, :, 0]
        now = now / np.maximum(now.max(axis=1, keepdims=True), 1e-300)
    return out


def _expect(models: list[Hmm], x: np.ndarray, first: bool = True, carry: np.ndarray | None = None) -> np.ndarray:
    """Sufficient statistics of a chunk for each model: log-likelihood, start, transitions, weights, sums, sums of squares."""
    s, k = len(models), len(models[0].start)
    carry = _carry(_summary(models, x, first)[None], k)[0] if carry is None else carry
    steps, _ = _steps(models, x, first)
    a = _carried(steps, carry[:, :k])
    back = _carried(steps[::-1].swapaxes(-1, -2), carry[:, k : 2 * k])  # states before the last row, before the one before it, ...
    b = np.concatenate([back[:-1][::-1], carry[None, :, k : 2 * k]])
    g = a * b
    g /= np.maximum(g.sum(axis=2, keepdims=True), 1e-300)
    pairs = np.concatenate([carry[None, :, :k], a[:-1]])[:, :, :, None] * steps * b[:, :, None, :]
    pairs /= np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300)
    pairs = pairs[int(first) :].sum(axis=0)
    start = g[0] if first else np.zeros((s, k))
    sums, squares = np.einsum("tsk,tf->skf", g, x), np.einsum("tsk,tf->skf", g, x * x)
    return np.concatenate([carry[:, -1:], start, pairs.reshape(s, -1), g.sum(axis=0), sums.reshape(s, -1), squares.reshape(s, -1)], axis=1)


def _best(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Max-plus products (..., i, m) and (..., m, j)."""
    return (scores[..., :, :, None] + steps[..., None, :, :]).max(axis=-2)


def _log_steps(model: Hmm, x: np.ndarray, first: bool) -> np.ndarray:
    e = model.emission(x)
    out = np.log(model.transition + 1e-300) + e[:, None, :]
    if first:
        out[0] = np.log(model.start + 1e-300) + e[0]
    return out


def _nothing(k: int) -> np.ndarray:
    return np.where(np.eye(k) > 0, 0.0, -np.inf)


def _best_product(steps: np.ndarray) -> np.ndarray:
    """The max-plus product of (n, k, k) in order, by pairs."""
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps, _nothing(steps.shape[-1])[None]])
        steps = _best(steps[0::2], steps[1::2])
    return steps[0]


def _ends(products: np.ndarray) -> list[tuple[int, int]]:
    """The best path's state before and at the end of each of the parts (c, k, k) of a sequence."""
    best, back = np.zeros(products.shape[-1]), []
    for m in products:
        step = best[:, None] + m
        back.append(step.argmax(axis=0))
        best = step.max(axis=0)
    state, out = int(best.argmax()), []
    for choice in reversed(back):
        before = int(choice[state])
        out.append((before, state))
        state = before
    return out[::-1]


def _path(steps: np.ndarray, before: int, after: int) -> np.ndarray:
    """The best states of the rows (n, k, k) between two given ones: ends of blocks, then all blocks at once."""
    n, k = steps.shape[:2]
    blocks = _in_blocks(steps, _nothing(k))
    products = blocks[:, 0]
    for l in range(1, blocks.shape[1]):
        products = _best(products, blocks[:, l])
    only = lambda state: np.where(np.arange(k) == state, 0.0, -np.inf)
    products[0] = products[0] + only(before)[:, None]
    products[-1] = products[-1] + only(after)
    ends = np.array(_ends(products))
    count, rows = blocks.shape[:2]
    at, now, back = np.arange(count), blocks[np.arange(count), 0, ends[:, 0]], np.zeros((rows, count, k), int)
    for l in range(1, rows):
        step = now[:, :, None] + blocks[:, l]
        back[l], now = step.argmax(axis=1), step.max(axis=1)
    out, state = np.empty((count, rows), int), ends[:, 1]
    for l in range(rows - 1, -1, -1):
        out[:, l] = state
        state = back[l][at, state]
    return out.reshape(-1)[:n]


#: Rows of a chunk at most: a day of bars of 10 seconds, a year of bars of an hour.
ROWS = 8_640

#: Rows below which a task is not worth its start.
LEAST = 2_000


def _packed(rows: DataFrame, keys: list[str], columns: tuple[str, ...], chunk: int | None, more: tuple[str, ...] = ()) -> DataFrame:
    """A row a chunk of a segment (keys): its rows in order (time, columns, more), _first and _alone: whether it is the segment's first one, its only one.

    A chunk has ROWS rows, or spans `chunk` seconds, if given. So what a chunk costs by itself is spread over its rows, however wide bars are.
    """
    x = rows.dropna(subset=[*keys, "time"])
    if chunk is None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("time", *columns))
        x = x.withColumn("_chunk", F.floor((place - 1) / ROWS))
    else:
        x = x.withColumn("_chunk", F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (chunk * 1_000_000)))
    x = x.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("time", *columns, *more))).alias("_rows"))
    of = Window.partitionBy(*keys)
    return x.withColumns({"_first": F.col("_chunk") == F.min("_chunk").over(of), "_alone": F.count(F.lit(1)).over(of) == 1})


def _arrays(x: DataFrame, columns: tuple[str, ...]) -> list:
    """The values of a chunk's rows, an array a column."""
    return [F.col("_rows").getField(c).alias(c) for c in columns]


def _table(*arrays) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in arrays], axis=1)


def _numbers(of: pd.Series, shape: tuple) -> np.ndarray:
    return np.stack([np.asarray(v, float).reshape(shape) for v in of])


def _round(x: DataFrame, keys: list[str], now: dict, names: list, model_keys: tuple[str, ...], columns: tuple[str, ...], k: int, tasks: int, cut: bool) -> DataFrame:
    """Statistics (model, seed, i, v) of all segments. A segment of one chunk needs no other, and takes at most `tasks` tasks with
    its like; of others (if any are cut) products of chunks, a carry over the chunks of a segment, then each chunk by itself."""
    kinds = ", ".join(f"{c} {t}" for c, t in x.select(*keys).dtypes)
    of = lambda key: now.get(tuple(key)) or []

    def product(parts):
        for rows in parts:
            out = []
            for at, key, first, of_key, *values in zip(rows.index, zip(*(rows[c] for c in keys), strict=True), rows["_first"], zip(*(rows[c] for c in model_keys), strict=True), *(rows[c] for c in columns), strict=True):
                models = [m for _, m in of(of_key)]
                if models:
                    out.append((*key, rows["_chunk"][at], _summary(models, _table(*values), bool(first)).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "_chunk", "v"])

    def carry(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk")
        models = of(rows[c].iat[0] for c in model_keys)
        found = _carry(_numbers(rows["v"], (len(models), k * k + 1)), k)
        return rows.assign(v=[v.ravel() for v in found])

    def expect(parts):
        total: dict = {}
        for rows in parts:
            for key, first, v, *values in zip(zip(*(rows[c] for c in model_keys), strict=True), rows["_first"], rows["v"], *(rows[c] for c in columns), strict=True):
                models = of(key)
                if models:
                    found = _expect([m for _, m in models], _table(*values), bool(first), None if v is None else _numbers([v], (len(models), 2 * k + 1))[0])
                    total[key] = total.get(key, 0) + found
        out = [(names.index(key), s, i, v) for key, found in total.items() for (s, _), row in zip(of(key), found, strict=True) for i, v in enumerate(row)]
        yield pd.DataFrame(out, columns=["model", "seed", "i", "v"])

    table, given = f"{kinds}, _chunk long, v array<double>", [*model_keys, "_first", *_arrays(x, columns)]
    wanted = x.where("_alone").coalesce(tasks).select(*given, F.lit(None).cast("array<double>").alias("v"))
    if cut:
        apart = x.where("not _alone")
        carried = apart.select(*keys, "_chunk", "_first", *_arrays(x, columns)).mapInPandas(product, table).groupBy(*keys).applyInPandas(carry, table)
        wanted = wanted.unionByName(apart.join(carried, [*keys, "_chunk"]).select(*given, "v"))
    return wanted.mapInPandas(expect, "model int, seed int, i int, v double").groupBy("model", "seed", "i").agg(F.sum("v").alias("v"))


def _started(mean: np.ndarray, var: np.ndarray, levels: np.ndarray, seed: int) -> Hmm:
    draw, k = np.random.default_rng(seed), len(levels)
    means = mean + draw.normal(0, 0.3, (k, len(mean))) * np.sqrt(var)
    means[:, 0] = levels + draw.normal(0, 0.05, k) * np.sqrt(var[0])
    return Hmm(means, np.tile(var, (k, 1)), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), np.full(k, 1 / k))


def _improved(v: np.ndarray, k: int, f: int, least: np.ndarray) -> Hmm:
    start, pairs = v[1 : 1 + k] + 1e-9, v[1 + k : 1 + k + k * k].reshape(k, k) + 1e-9
    weight, rest = np.maximum(v[1 + k + k * k : 1 + 2 * k + k * k], 1e-9)[:, None], v[1 + 2 * k + k * k :].reshape(2, k, f)
    means = rest[0] / weight
    return Hmm(means, np.maximum(rest[1] / weight - means**2, least), pairs / pairs.sum(axis=1, keepdims=True), start / start.sum(), v[0])


def hmm_fit(features: DataFrame, columns: tuple[str, ...] = FEATURES, k: int = 3, seeds: int = 5, rounds: int = 100, tolerance: float = 1e-4, model_keys: tuple[str, ...] = ("asset",), segment: tuple[str, ...] = ("asset", "month"), chunk: int | None = None) -> dict[tuple, Hmm]:
    """L1: a model for each of model_keys (an asset; an asset and fold), the best of the seeds by likelihood.

    EM over segments, each a sequence of its own in the order of `time`; nulls, NaN and infinite values count as 0. Segments
    are packed once into chunks of ROWS rows (or `chunk` seconds), whose products of matrices tell what they hand on, so that a
    segment's chunks are several tasks, and no loop is longer than the root of a chunk's rows. A round is one job for all models
    and seeds that still improve; what comes to the driver are statistics of size k * k a model and seed. It stops when no
    log-likelihood rises by more than `tolerance` of itself.
    """
    f, keys = len(columns), list(dict.fromkeys([*model_keys, *segment]))
    x = _packed(nan_to_num(with_month(features).select(*keys, "time", *columns), list(columns)), keys, columns, chunk)
    x = x.repartition(*keys, "_chunk").persist()
    levels = [0.1, 0.5, 0.9] if k == 3 else [(i + 0.5) / k for i in range(k)]
    flat = x.select(*model_keys, F.explode("_rows").alias("_row")).select(*model_keys, "_row.*")
    stats = flat.groupBy(*model_keys).agg(*(F.avg(c) for c in columns), *(F.var_pop(c) for c in columns), F.percentile_approx(columns[0], levels, 10_000), F.count(F.lit(1))).collect()  # a row a model
    cut, tasks = not x.where("not _alone").isEmpty(), max(1, sum(r[-1] for r in stats) // LEAST)
    names, models, least = [], {}, {}
    for r in stats:
        key, values = tuple(r[: len(model_keys)]), list(r[len(model_keys) :])
        mean, var = np.array(values[:f], float), np.maximum(np.array(values[f : 2 * f], float), 1e-12)
        names.append(key)
        least[key] = var * 1e-6
        for s in range(seeds):
            models[key, s] = _started(mean, var, np.array(values[2 * f], float), s)
    going = {k: -np.inf for k in models}
    for _ in range(rounds):
        if not going:
            break
        now = {key: [(s, models[key, s]) for s in range(seeds) if (key, s) in going] for key in names}
        for (number, s), rows in _round(x, keys, now, names, model_keys, columns, k, tasks, cut).toPandas().groupby(["model", "seed"]):  # k * k numbers a model and seed
            key = names[number]
            new = _improved(rows.sort_values("i").v.to_numpy(), k, f, least[key])
            if new.score - going[key, s] < tolerance * max(1.0, abs(new.score)):
                del going[key, s]
            else:
                going[key, s] = new.score
            models[key, s] = new
    x.unpersist()
    return {key: max((models[key, s] for s in range(seeds)), key=lambda m: m.score) for key in names}


def hmm_parameters(models: dict[tuple, Hmm], columns: tuple[str, ...] = FEATURES) -> list[tuple]:
    """Rows (*key, state, feature, mean, var), states ranked by their mean of the first column; for L9."""
    out = []
    for key, m in models.items():
        for rank, state in enumerate(np.argsort(m.means[:, 0])):
            out += [(*key, rank, c, float(m.means[state, j]), float(m.variances[state, j])) for j, c in enumerate(columns)]
    return out


def hmm_decode(models: dict[tuple, Hmm], features: DataFrame, columns: tuple[str, ...] = FEATURES, model_keys: tuple[str, ...] = ("asset",), segment: tuple[str, ...] = ("asset", "month"), chunk: int | None = None) -> DataFrame:
    """L2 and L3: Viterbi path by segment; label is the rank of the state by its mean of the first column. A key without a model has no labels.

    As in hmm_fit, by chunks: max-plus products, the best states at the ends of a segment's chunks, and each chunk between them.
    """
    keys = list(dict.fromkeys([*model_keys, *segment]))
    kept = list(dict.fromkeys([*model_keys, "asset", "time"]))
    more = tuple(c for c in kept if c not in keys and c not in ("time", *columns))
    of = lambda key: models.get(tuple(key))

    def product(parts):
        for rows in parts:
            out = []
            for at, key, first, of_key, *values in zip(rows.index, zip(*(rows[c] for c in keys), strict=True), rows["_first"], zip(*(rows[c] for c in model_keys), strict=True), *(rows[c] for c in columns), strict=True):
                if of(of_key) is not None:
                    out.append((*key, rows["_chunk"][at], _best_product(_log_steps(of(of_key), _table(*values), bool(first))).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "_chunk", "v"])

    def ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, k = rows.sort_values("_chunk"), len(of(rows[c].iat[0] for c in model_keys).start)
        found = _ends(_numbers(rows["v"], (k, k)))
        return rows.drop(columns="v").assign(before=[b for b, _ in found], after=[a for _, a in found])

    def path(key, first, before, after, *values):
        model = of(key)
        if model is None:
            return None
        steps = _log_steps(model, _table(*values), bool(first))
        between = _ends(_best_product(steps)[None])[0] if pd.isna(before) else (int(before), int(after))
        return np.argsort(np.argsort(model.means[:, 0]))[_path(steps, *between)].astype("int32")

    @F.pandas_udf("array<int>")
    def paths(first: pd.Series, before: pd.Series, after: pd.Series, *others: pd.Series) -> pd.Series:
        n = len(model_keys)
        return pd.Series([path(row[3 : 3 + n], *row[:3], *row[3 + n :]) for row in zip(first, before, after, *others, strict=True)], dtype=object)

    wanted = nan_to_num(with_month(features).select(*dict.fromkeys([*keys, *kept, *columns])), list(columns))
    x = _packed(wanted, keys, columns, chunk, more)
    kinds = dict(x.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _chunk long"
    apart = x.where("not _alone").select(*keys, "_chunk", "_first", *_arrays(x, columns))
    found = apart.mapInPandas(product, f"{named}, v array<double>").groupBy(*keys).applyInPandas(ends, f"{named}, before int, after int")
    x = x.join(found, [*keys, "_chunk"], "left")
    x = x.withColumn("_label", paths("_first", "before", "after", *model_keys, *_arrays(x, columns)))
    x = x.select(*(c for c in kept if c in keys), F.explode(F.arrays_zip("_rows", "_label")).alias("_row"))
    return x.select(*(F.col(c) if c in keys else F.col(f"_row._rows.{c}").alias(c) for c in kept), F.col("_row._label").alias("label")).where("label is not null")


def rank_states(means: DataFrame) -> DataFrame:
    """L3: (asset, state, mean) to label 0, 1, 2 by mean."""
    return means.withColumn("label", (F.row_number().over(Window.partitionBy("asset").orderBy("mean", "state")) - 1).cast("int"))


def label_distribution(labels: DataFrame, *keys: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """L4: percent of each label by key."""
    return labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *((F.avg((F.col("label") == c).cast("double")) * 100).alias(f"pct_{c}") for c in classes))


def event_label_rates(labels: DataFrame, events: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Percent of each label in each event (name, start, stop), half-open. events is a fixed dimension of few rows."""
    j = labels.join(F.broadcast(events), (F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop")))
    return label_distribution(j, "name", "asset", classes=classes)


def transition_matrix(labels: DataFrame, width: float = 10) -> DataFrame:
    """from_label, to_label, n, p of steps from a bar to the next one (width: seconds of a bar); a gap is no step."""
    x = in_reach(labels.select("asset", "time", F.col("label").alias("to_label")), 1, width)
    pairs = own_rows(x.withColumn("from_label", F.lag("to_label").over(reach_window()))).where("from_label is not null")
    counts = pairs.groupBy("asset", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("asset", "from_label")))


def local_labels(features: DataFrame, windows: DataFrame, folds: list[int], columns: tuple[str, ...] = FEATURES, **fit) -> DataFrame:
    """For each fold, labels of its test window (window, start, stop) from each asset's model of the windows before it.

    The models of all folds and assets are fitted by the same jobs. windows: few rows.
    """
    j = with_month(features).join(F.broadcast(windows), (F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop")))
    train = j.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).where(F.col("window") < F.col("fold"))
    test = j.where(F.col("window").isin(list(folds))).withColumn("fold", F.col("window"))
    keys = ("asset", "fold")
    models = hmm_fit(train, columns, model_keys=keys, segment=("asset", "window", "month"), **fit)
    return hmm_decode(models, test, columns, keys, ("asset", "window", "month"))


def label_agreement(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Agreement overall and within each label of a, and both shares of stress, in percent."""
    j = a.select("asset", "time", F.col("label").alias("x")).join(b.select("asset", "time", F.col("label").alias("y")), ["asset", "time"])
    same = (F.col("x") == F.col("y")).cast("double")
    within = [F.avg(F.when(F.col("x") == c, same * 100)).alias(f"agree_{c}") for c in (0, 1, 2)]
    return j.groupBy(*(keys or ("asset",))).agg(F.count(F.lit(1)).alias("n"), F.avg(same * 100).alias("agree"), *within, F.avg((F.col("x") == 2).cast("double") * 100).alias("stress_a"), F.avg((F.col("y") == 2).cast("double") * 100).alias("stress_b"))


def param_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of means and variances of (asset, state, feature, mean, var), states ranked alike."""
    j = a.alias("a").join(b.alias("b"), ["asset", "state", "feature"])
    return j.groupBy("asset").agg(F.max(F.abs(F.col("a.mean") - F.col("b.mean"))).alias("max_mean_diff"), F.max(F.abs(F.col("a.var") - F.col("b.var"))).alias("max_var_diff"))


def hmm_blocks(models: dict[tuple, Hmm]) -> list[tuple]:
    """Rows (*key, block, state, to, value) of the start and transition probabilities, states ranked by their mean of the first column; for L9."""
    out = []
    for key, m in models.items():
        order = np.argsort(m.means[:, 0])
        for rank, state in enumerate(order):
            out.append((*key, "start", rank, -1, float(m.start[state])))
            out += [(*key, "transition", rank, to, float(m.transition[state, s])) for to, s in enumerate(order)]
    return out


def block_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference in each block of (asset, block, state, to, value), states ranked alike."""
    j = a.alias("a").join(b.alias("b"), ["asset", "block", "state", "to"])
    return j.groupBy("asset", "block").agg(F.max(F.abs(F.col("a.value") - F.col("b.value"))).alias("max_diff"))


def global_vs_local_summary(agreement: DataFrame, folds: DataFrame) -> DataFrame:
    """Every (fold, asset) with its agreement and difference of stress shares; null where a fold failed."""
    j = folds.join(agreement, ["fold", "asset"], "left")
    return j.select("fold", "asset", "agree", F.abs(F.col("stress_a") - F.col("stress_b")).alias("stress_diff"))
