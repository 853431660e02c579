"""Whitening of embeddings from a covariance weighted by multiplicity.

Equal vectors are one row with a count. Sums, the covariance and its check weigh each distinct vector by its count (fit on
rows) or by one (fit on distinct vectors); each distinct vector is whitened once, and rows get theirs by a join.

Entries are turned into whole numbers first, so that sums and deviations are exact at any size of the table. Partial sums
and products are made in numpy, a batch at a time, and added up in Spark; what comes to the driver is one vector of sums and
one covariance matrix, whose size depends on the dimensions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

UNIT, SHIFT, MOST = 64, 1_000_000, 32
#: Directions with less of the variance than this are rounding, not data.
NOTHING = 1e-12
#: Whole numbers end here, so that their sums stay exact; a larger entry counts as this.
LARGEST = 1 << 52


def whole(vectors: pa.ListArray, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Which vectors count (of the given length, all entries finite), and those as whole numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), max(dims, 1)), False)
    x = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(dims, 1))  # null becomes NaN
    good = np.isfinite(x).all(axis=1)
    counts = np.array(fits.to_pylist(), bool)
    counts[counts] = good
    return pa.array(counts), np.clip(np.floor(x[good] * UNIT), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None where one isn't a long. Sums of longs wrap around, so they are right wherever the true sum is a long."""
    about = (d.astype(float) ** 2).sum(axis=1)
    fits = d.dtype != object
    wrapped = (d * d).sum(axis=1).tolist() if fits else [0] * len(d)
    out = []
    for k, (near, exact) in enumerate(zip(about.tolist(), wrapped, strict=True)):
        if not fits or 0.999 < near / 2.0**63 < 1.001:
            exact = sum(int(v) ** 2 for v in d[k])
        out.append(exact if near < 1.001 * 2.0**63 and exact < 1 << 63 else None)
    return out


@dataclass
class Whitening:
    """What is known of the fit list: rows, sums by dimension, components (columns of axes) and their variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if max(map(abs, self.sums), default=0) + self.n * (int(np.abs(x).max()) if x.size else 0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def apply(self, scaled: np.ndarray) -> np.ndarray:
        return (scaled.astype(float) / self.n) @ (self.axes / np.sqrt(self.variances))


def dimensions(rows: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of a vector (the larger of two as frequent); 0 without any."""
    sizes = rows.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.where("d > 0").agg(F.max(F.struct("n", "d"))).first()[0]
    return found["d"] if found else 0


def numbered(rows: DataFrame, dims: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and x (whole numbers as little-endian longs) of each row that counts."""

    def run(batches):
        for b in batches:
            fits, x = whole(b.column(1), dims)
            raw = pa.array([v.tobytes() for v in x.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(fits), raw], ["key", "x"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).mapInArrow(run, f"key {kind}, x binary")


def _matrix(raw: pa.Array, dims: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, max(dims, 1))


def _sums(groups: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension, counts as weights."""

    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            x, w = _matrix(b.column(0), dims), b.column(1).to_numpy()
            n += int(w.sum())
            if x.size and float(np.abs(x).max()) * float(w.sum()) < 2.0**62:
                total = total + (w @ x).astype(object)
            elif x.size:
                total = total + w.astype(object) @ x.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([str(n), *map(str, total)])], ["at", "value"])

    parts = groups.select("x", "weight").mapInArrow(run, "at int, value string")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38, 0)")).cast("string")).collect())  # a row a dimension
    return int(found.get(-1) or 0), [int(found.get(k) or 0) for k in range(dims)]


def _products(parts: DataFrame, size: int) -> np.ndarray:
    """The sum over partitions of their matrices (rows at, values), as one matrix."""
    cells = parts.select("at", F.posexplode("values").alias("to", "value")).groupBy("at", "to").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    for at, to, value in cells.collect():  # size * size rows
        out[at, to] = value
    return out


def _gemm(groups: DataFrame, columns: list[str], size: int, centred) -> np.ndarray:
    """Sum of weight * v v' over rows of groups, where centred makes the vectors v of a batch."""

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            v = centred(b)
            total += (v * b.column("weight").to_numpy()[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["at", "values"])

    return _products(groups.select("weight", *columns).mapInArrow(run, "at int, values array<double>"), size)


def fit(groups: DataFrame, dims: int, most: int = MOST) -> Whitening:
    """The whitening of groups (x, weight): at most `most` components by falling variance, none that is only rounding."""
    n, sums = _sums(groups, dims) if dims else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    plain = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    cov = _gemm(groups, ["x"], dims, lambda b: plain.scaled(_matrix(b.column("x"), dims)).astype(float) / n) / n
    variances, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-variances, kind="stable")[:most]
    order = order[variances[order] > NOTHING * max(np.trace(cov), 0.0)]
    return Whitening(n, sums, axes[:, order], variances[order], float(np.trace(cov)))


def distinct_vectors(numbers: DataFrame, multiplicity: bool = True) -> DataFrame:
    """x and weight (how many rows have it, or one) of each distinct vector; counted before anything is shuffled."""
    counted = numbers.groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    return counted if multiplicity else counted.withColumn("weight", F.lit(1).cast("long"))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = MOST, multiplicity: bool = True) -> DataFrame:
    """For each row that counts and each component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, holds a null or a value that isn't finite, or has another length than most rows of the table
    don't count and give nothing. Repeated rows give theirs as often as they come; other columns are left out. A direction
    without variance has no component, so a table of equal vectors and an empty one give no rows. Entries beyond 2^46 count
    as that; a deviation that is no long is null.
    """
    dims = dimensions(rows, column)
    # 32 bytes name a vector where rows and vectors are joined
    numbers = numbered(rows, dims, key, column)
    groups = materialise(distinct_vectors(numbers, multiplicity), "vectors")
    found = fit(groups, dims, most)
    size = found.axes.shape[1]

    def run(batches):
        for b in batches:
            scaled = found.scaled(_matrix(b.column("x"), dims)) if size else np.zeros((0, 0))
            keep = b if size else b.slice(0, 0)
            done = found.apply(scaled) if size else scaled
            columns = [keep.column("x_key"), keep.column("weight"), pa.array(_squares(scaled) if size else [], pa.int64()), pa.array([z.tobytes() for z in done.astype("<f8")], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["x_key", "weight", "deviation", "z"])

    x_key = F.unhex(F.sha2("x", 256)).alias("x_key")
    done = materialise(groups.select("x", x_key, "weight").mapInArrow(run, "x_key binary, weight long, deviation long, z binary"), "whitened")
    release(groups)
    error = None
    if size:
        # whitened values are centred again by their own mean
        def mean_of(batches):
            total = np.zeros(size)
            for b in batches:
                total += b.column(1).to_numpy() @ _matrix(b.column(0), size, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "value"])

        means = dict(done.select("z", "weight").mapInArrow(mean_of, "at int, value double").groupBy("at").agg(F.sum("value")).collect())  # a row a component
        mean = np.array([means[k] for k in range(size)]) / found.n
        cov = _gemm(done, ["z"], size, lambda b: _matrix(b.column("z"), size, "<f8") - mean) / found.n
        error = float(np.abs(cov - np.eye(size)).max())
    explained = (found.variances / found.trace).tolist() if size else []

    def spread(batches):
        """A row a component."""
        for b in batches:
            z = _matrix(b.column("z"), size, "<f8") if size else np.zeros((0, 0))
            at = pa.array(np.repeat(np.arange(len(z)), size))
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(z))), b.column("deviation").take(at), pa.array(z.ravel())], ["key", "component", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    joined = numbers.select("key", x_key).join(done.drop("weight"), "x_key").select("key", "deviation", "z")
    out = joined.mapInArrow(spread, f"key {kind}, component int, deviation long, whitened double")
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component")) if size else F.lit(None).cast("double")
    return out.select(F.col("key").alias(key), "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
