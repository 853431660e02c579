"""Gradient boosting on histograms, for many models at once.

Rows become blocks of binned features, labels and margins. A level of the trees of all models is one job: each task sums the
gradients of its blocks by node, feature and bin, tables of one node are added up and the best cut found where they meet, and
the driver gets one row a node. Margins are written anew every few rounds, so that a row passes few trees a job.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise, release

ROUNDS, DEPTH, RATE, BINS, SHARE, SMOOTH, LEAST, HOLD = 300, 6, 0.05, 64, 0.8, 1.0, 1.0, 15


@dataclass
class Task:
    """What a model learns: an integer label (null: not one of its rows), a weight, and the number of classes (2: one margin, by logistic)."""

    name: tuple
    label: str
    weight: str
    classes: int = 2

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes


class Tree:
    """Cuts and values by node, in heap order; a node without a cut keeps its rows."""

    def __init__(self, depth: int):
        self.feature, self.bin, self.value = np.full(2**depth - 1, -1, np.int16), np.zeros(2**depth - 1, np.int16), np.zeros(2 ** (depth + 1) - 1)

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        for _ in range(levels):
            inner = at < len(self.feature)
            f = np.where(inner, self.feature[np.minimum(at, len(self.feature) - 1)], -1)
            right = x[rows, np.maximum(f, 0)] > self.bin[np.minimum(at, len(self.feature) - 1)]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """A fitted model; transform adds `probability` (an array) and `prediction`, as MLlib's models do."""

    features: list[str]
    edges: list[np.ndarray]
    classes: int
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)  # by round and output

    def probs(self, values: np.ndarray) -> np.ndarray:
        x = binned(values, self.edges)
        m = np.zeros((len(x), 1 if self.classes == 2 else self.classes))
        for each in self.trees:
            for k, t in enumerate(each):
                m[:, k] += t.value[t.nodes(x, self.depth)]
        p = _probs(m)
        return np.concatenate([1 - p, p], axis=1) if self.classes == 2 else p

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("array<double>")
        def found(values: pd.DataFrame) -> pd.Series:
            return pd.Series(list(model.probs(values.to_numpy(float))))

        x = df.withColumn("probability", found(F.struct(*(F.col(c).cast("double").alias(c) for c in self.features))))
        return x.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value; NaN is in the last one."""
    return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def _probs(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(keys: np.ndarray, seed: int, n: int, share: float) -> np.ndarray:
    """A share of the rows, by a hash of their keys, the seed and the round."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + n) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def best_cut(table: np.ndarray, allowed: np.ndarray, smooth: float, least: float):
    """(feature, bin, gradients and weights left and right of it) of the greatest gain over a table (features, bins, 2); feature -1 if none gains."""
    left = table.cumsum(axis=1)[:, :-1]
    total = table[0].sum(axis=0)
    right = total - left
    gain = left[..., 0] ** 2 / (left[..., 1] + smooth) + right[..., 0] ** 2 / (right[..., 1] + smooth) - total[0] ** 2 / (total[1] + smooth)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least) & allowed[:, None], gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-9:
        return (-1, 0, *total, 0.0, 0.0)
    return (int(f), int(b), *left[f, b], *right[f, b])


def fit_many(rows: DataFrame, features: list[str], tasks: list[Task], seeds: Iterable[int] = (42,), key: str | None = None, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, share: float = SHARE, columns: float = SHARE, smooth: float = SMOOTH, least: float = LEAST, hold: int = HOLD) -> dict[tuple, Boosted]:
    """A model for each task and seed: (*task.name, seed) -> Boosted. Missing values are bins of their own at the upper end.

    Each round takes a share of the rows (by a hash of `key`, or of the features) and each tree a share of the columns.
    """
    parts = [k / bins for k in range(1, bins)]
    found = rows.select(*(F.col(c).cast("double").alias(c) for c in features)).agg(*(F.percentile_approx(c, parts, 10_000) for c in features)).first()
    edges = [np.unique(np.array([v for v in e or [] if v is not None and np.isfinite(v)], float)) for e in found]
    names = [(*t.name, s) for t in tasks for s in seeds]
    of = [(i, s, t.outputs) for i, t in enumerate(tasks) for s in seeds]  # task, seed and outputs of each model
    firsts = np.cumsum([0, *(o for _, _, o in of)])
    models = {n: Boosted(features, edges, t.classes, depth) for n, t in zip(names, [t for t in tasks for _ in seeds], strict=True)}
    outputs, n_features, n_tasks = int(firsts[-1]), len(features), len(tasks)
    schema = "x binary, y binary, w binary, keys binary, m binary"

    def block(batches):
        for b in batches:
            values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_features)], axis=1)
            y = np.stack([b.column(n_features + k).fill_null(-1).to_numpy(zero_copy_only=False) for k in range(n_tasks)], axis=1).astype(np.int8)
            w = np.stack([b.column(n_features + n_tasks + k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(n_tasks)], axis=1).astype(np.float32)
            data = (binned(values, edges), y, w, b.column(n_features + 2 * n_tasks).to_numpy(), np.zeros((len(y), outputs), np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in data], names=["x", "y", "w", "keys", "m"])

    def opened(batch):
        for k in range(batch.num_rows):
            x, y, w, keys, m = (batch.column(c)[k].as_py() for c in range(5))
            n = len(keys) // 8
            yield np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y, np.int8).reshape(n, -1), np.frombuffer(w, np.float32).reshape(n, -1), np.frombuffer(keys, np.int64), np.frombuffer(m, np.float32).reshape(n, -1).copy()

    def add(m, x, pending):
        for done in pending:
            for out, tree in enumerate(done):
                m[:, out] += tree.value[tree.nodes(x, depth)]
        return m

    def tables(pending, growing, level, n):
        low, width = 2**level - 1, 2**level

        def run(batches):
            sums = np.zeros((outputs, width, n_features, bins, 2))
            for batch in batches:
                for x, y, w, keys, m in opened(batch):
                    m = add(m, x, pending)
                    for (task, seed, outs), first in zip(of, firsts, strict=False):
                        use = np.flatnonzero((y[:, task] >= 0) & sampled(keys, seed, n, share))
                        p, mine, weight, xs = _probs(m[use, first : first + outs].astype(float)), y[use, task], w[use, task].astype(float), x[use]
                        for k in range(outs):
                            node = growing[first + k].nodes(xs, level) - low
                            here = np.flatnonzero(node >= 0)  # the others are in nodes that aren't cut
                            hit = mine[here] == (1 if outs == 1 else k)
                            g, h = (p[here, k] - hit) * weight[here], p[here, k] * (1 - p[here, k]) * weight[here] * (1 if outs == 1 else 2)
                            at = node[here] * bins
                            for f in range(n_features):
                                cell = at + xs[here, f]
                                sums[first + k, :, f, :, 0] += np.bincount(cell, g, width * bins).reshape(width, bins)
                                sums[first + k, :, f, :, 1] += np.bincount(cell, h, width * bins).reshape(width, bins)
            trees, nodes = np.nonzero(sums[:, :, 0, :, 1].sum(axis=2) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(nodes + low, pa.int32()), pa.array([sums[t, v].tobytes() for t, v in zip(trees, nodes, strict=True)], pa.binary())], names=["tree", "node", "sums"])

        return run

    def cut(allowed):
        def run(parts: pd.DataFrame) -> pd.DataFrame:
            out = []
            for (tree, node), each in parts.groupby(["tree", "node"]):
                table = np.sum([np.frombuffer(v) for v in each["sums"]], axis=0).reshape(n_features, bins, 2)
                out.append((tree, node, *best_cut(table, allowed[tree], smooth, least)))
            return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gl", "hl", "gr", "hr"])

        return run

    def moved(pending):
        def run(batches):
            for batch in batches:
                made = [add(m, x, pending).tobytes() for x, _, _, _, m in opened(batch)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(made, pa.binary())], names=["x", "y", "w", "keys", "m"])

        return run

    hashed = F.xxhash64(*([key] if key else features)).alias("_key")
    wanted = rows.select(*(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)), *(F.col(t.label).cast("int").alias(f"y{k}") for k, t in enumerate(tasks)), *(F.col(t.weight).cast("double").alias(f"w{k}") for k, t in enumerate(tasks)), hashed)
    written = materialise(wanted.mapInArrow(block, schema), "blocks")
    held, pending = written.persist(), []
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # nodes that are cut in one call
    for n in range(rounds):
        growing, rng = [Tree(depth) for _ in range(outputs)], [np.random.default_rng([s, n]) for _, s, _ in of]
        allowed = np.zeros((outputs, n_features), bool)
        for r, first, (_, _, outs) in zip(rng, firsts, of, strict=False):
            for k in range(outs):
                allowed[first + k, r.permutation(n_features)[: max(1, round(columns * n_features))]] = True
        for level in range(depth):
            sums = held.mapInArrow(tables(pending, growing, level, n), "tree int, node int, sums binary")
            cuts = sums.groupBy(F.pmod(F.hash("tree", "node"), F.lit(buckets))).applyInPandas(cut(allowed), "tree int, node int, feature int, bin int, gl double, hl double, gr double, hr double").collect()  # a row a node
            for c in cuts:
                t = growing[c.tree]
                if c.feature < 0:
                    t.value[c.node] = -rate * c.gl / (c.hl + smooth)
                else:
                    t.feature[c.node], t.bin[c.node] = c.feature, c.bin
                    t.value[2 * c.node + 1], t.value[2 * c.node + 2] = -rate * c.gl / (c.hl + smooth), -rate * c.gr / (c.hr + smooth)
            if not any(c.feature >= 0 for c in cuts):
                break
        for name, first, (_, _, outs) in zip(names, firsts, of, strict=False):
            models[name].trees.append(growing[first : first + outs])
        pending.append(growing)
        if len(pending) >= hold and n + 1 < rounds:
            new = materialise(held.mapInArrow(moved(pending), schema), "blocks")
            held.unpersist()
            release(written)
            written, pending = new, []
            held = written.persist()
    held.unpersist()
    release(written)
    return models
