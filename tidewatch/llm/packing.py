"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Lengths are at most the capacity, so the histogram has at most `capacity` entries at any corpus size. For each bin a
bitset subset-sum finds the fullest combination of available lengths beside the longest one; it is removed as often as
the counts allow, so the plan has about as many patterns as there are lengths. Pieces then find their place from their
rank among pieces of equal length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_tokenizer, filled, materialise, table, token_ids

CAPACITY, END_ID = 2048, 0
#: Equal lengths are ranked in parts of about so many pieces, so a length that a third of the pieces share isn't one task's work.
RANKED = 100_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination {length: times} with the greatest sum up to room, by subset-sum on the bits of an integer."""
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    mask, reach = (1 << room + 1) - 1, [1]
    for x in lengths:
        bits, left, step = reach[-1], min(counts[x], room // x), 1
        while left:
            bits |= bits << x * min(step, left)
            left -= min(step, left)
            step *= 2
        reach.append(bits & mask)
        if bits >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, {}
    for k in range(len(reach) - 1, 0, -1):
        x = lengths[k - 1]
        while not reach[k - 1] >> at & 1:
            at -= x
            out[x] = out.get(x, 0) + 1
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) of each pattern, until no length is left."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        combo = fullest({x: n for x, n in rest.items() if n}, capacity - top)
        combo[top] = combo.get(top, 0) + 1
        times = min(left[x] // c for x, c in combo.items())
        out.append((times, combo))
        for x, c in combo.items():
            left[x] -= c * times
            if not left[x]:
                del left[x]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only where longer than capacity."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(token_ids(filled(part.column(1)), tokenizer)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(ids[a:z].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(found: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. found must be cheap to read again.

    Pieces that fill a sequence need no rank; the others get theirs among pieces of equal length, in parts of about `ranked`.
    """
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    counts.pop(capacity, None)
    keys, base, each, first, seq = [], [], [], [], 0
    used: dict[int, int] = {}
    for times, combo in plan(counts, capacity):
        at = 0
        for x, c in sorted(combo.items(), reverse=True):
            keys.append((x << 44) + used.get(x, 0))
            base.append(seq)
            each.append(c)
            first.append(at)
            used[x] = used.get(x, 0) + c * times
            at += x * c
        seq += times
    order = np.argsort(np.array(keys, np.int64))
    keys, base, each, first = (np.array(v, np.int64)[order] for v in (keys, base, each, first))
    columns = found.columns
    full = found.where(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + seq).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(batches):
        for b in batches:
            x, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, (x << 44) + rank, side="right") - 1
            over = (x << 44) + rank - keys[k]
            out = b.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(base[k] + over // each[k])).append_column("offset", pa.array(first[k] + over % each[k] * x))

    parts = F.array(*(F.lit(-(-counts.get(x, 1) // ranked)) for x in range(capacity)))
    part = found.where(F.col("length") < capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.get(parts, F.col("length").cast("int"))))
    tally = part.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for `ranked` pieces, and one a length
    before = tally.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    placed = part.withColumn("at", F.row_number().over(w) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("at"))
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return placed.select(*columns, "rank").mapInArrow(run, schema).union(full)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; repeated rows are packed as often as they come; an empty table gives no rows. Texts of
    any length are encoded whole and cut into pieces of `capacity`, of which the first may be shorter; other columns of docs are
    left out.
    """
    found = materialise(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    return place(found, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
