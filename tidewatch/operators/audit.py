"""Quality audit of trades (Q1-Q8). Everything aggregates before it moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trade_summary(trades: DataFrame) -> DataFrame:
    """Q1. A null price or quantity is a bad one. ids are whole numbers; an asset's days span less than 89 years.

    Distinct ids and days are bits of bitmaps, of 32,768 ids each, which are built before the shuffle and merged after it.
    """
    n, day = F.count(F.lit(1)), F.pmod(F.unix_date(F.to_date("time")), F.lit(32768))
    counts = {
        "trades": n,
        "bad_price": F.count_if(F.col("price").isNull() | (F.col("price") <= 0)),
        "huge_price": F.count_if(F.col("price") > 1e7),
        "bad_qty": F.count_if(F.col("qty").isNull() | (F.col("qty") <= 0)),
        "null_keys": F.count_if(F.col("id").isNull() | F.col("time").isNull()),
    }
    parts = trades.groupBy("asset", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("ids"), F.bitmap_construct_agg(day).alias("days"), *(c.alias(k) for k, c in counts.items()), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )
    whole = parts.groupBy("asset").agg(
        F.bitmap_count(F.bitmap_or_agg("days")).alias("days"), F.sum(F.bitmap_count("ids")).alias("ids"), *(F.sum(k).alias(k) for k in counts), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )
    return whole.select("asset", "days", "trades", (F.col("trades") - F.col("ids")).alias("duplicates"), "bad_price", "huge_price", "bad_qty", "null_keys", "first_time", "last_time")


def low_count_days(trades: DataFrame, least: int = 1000) -> DataFrame:
    """Q2."""
    return trades.groupBy("asset", F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("trades")).where(F.col("trades") < least)


def expected_months(listed: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """Q3: asset and month of every window, from the month in which the asset was listed. listed: asset, listed (yyyy-MM), a row an asset."""
    months = [F.sequence(F.lit(f"{a}-01").cast("date"), F.lit(f"{z}-01").cast("date"), F.expr("interval 1 month")) for a, z in windows]
    every = listed.select("asset", "listed", F.explode(F.array_distinct(F.concat(*months))).alias("month"))
    return every.where(F.date_format("month", "yyyy-MM") >= F.col("listed")).select("asset", "month")


def missing_partitions(expected: DataFrame, present: DataFrame, least_bytes: int | None = None) -> DataFrame:
    """Q4: expected asset-months that are absent, or smaller than least_bytes where present has `bytes`."""
    enough = present if least_bytes is None else present.where(F.col("bytes") >= least_bytes)
    return expected.join(enough, ["asset", "month"], "left_anti")


def missing_days(trades: DataFrame) -> DataFrame:
    """Q5: days without a trade in each asset-month that has any."""
    days = trades.select("asset", F.to_date("time").alias("day")).distinct()
    month = days.select("asset", F.trunc("day", "month").alias("m")).distinct()
    calendar = month.select("asset", F.explode(F.sequence("m", F.last_day("m"), F.expr("interval 1 day"))).alias("day"))
    return calendar.join(days, ["asset", "day"], "left_anti")


def schema_check(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Q6: raw has strings; per file and column, how many values can't be read as their type."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in kinds.items()]
    wide = raw.groupBy(F.col("_metadata.file_name").alias("file")).agg(*bad)
    return wide.unpivot("file", list(kinds), "column", "bad_values")


def feature_inventory(features: DataFrame, expected: list[str]) -> DataFrame:
    """Q7: rows by file, and which expected columns the table lacks."""
    lacking = ",".join(c for c in expected if c not in features.columns)
    counts = features.groupBy("asset", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumns({"n_columns": F.lit(len(features.columns)), "lacking": F.lit(lacking)})


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Q7: file, rows and columns of each Parquet file below path, from its footer; footers are read in tasks, contents not at all."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    def run(batches):
        for b in batches:
            rows, columns = [], []
            for uri in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                with store.open_input_file(at) as f:
                    footer = pq.read_metadata(f)
                rows.append(footer.num_rows)
                columns.append(footer.schema.to_arrow_schema().names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.int64()), pa.array(columns, pa.list_(pa.string()))], names=["file", "rows", "columns"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file")).mapInArrow(run, "file string, rows long, columns array<string>")


def column_mismatches(schemas: DataFrame, asset=None) -> DataFrame:
    """Q7: files whose columns (or their order) differ from those of the asset's first file by name."""
    asset = F.regexp_extract("file", r"([A-Z0-9]+)[-_][^/]*$", 1) if asset is None else asset
    x = schemas.withColumn("asset", asset)
    first = x.groupBy("asset").agg(F.min_by("columns", "file").alias("expected"))  # a row an asset
    return x.join(F.broadcast(first), "asset").where(F.col("columns") != F.col("expected")).select("asset", "file", "expected", F.col("columns").alias("found"))


def quality_score(issues: DataFrame) -> DataFrame:
    """Q8."""
    n = F.count(F.lit(1))
    return issues.agg(n.alias("issues"), F.when(n == 0, "PASSED").otherwise("FAILED").alias("status"), F.greatest(F.lit(0), 100 - 10 * n).cast("long").alias("score"))
