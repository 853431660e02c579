"""Reading, stitching and writing of trades and features."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean, is_best_match boolean"
TRADE = "id long, price double, qty double, quote_qty double, time timestamp, is_buyer_maker boolean, is_best_match boolean"


def asset_from_path(path=None):
    """The leading letters of the file name; BTCUSDT-trades-2022-05.csv gives BTCUSDT."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.regexp_extract(path, r"([A-Z0-9]+)[-_][^/]*$", 1)


def month_of_path(path=None):
    path = F.col("_metadata.file_path") if path is None else path
    return F.to_date(F.concat(F.regexp_extract(path, r"(\d{4}-\d{2})[^/]*$", 1), F.lit("-01")))


def read_trades_csv(spark: SparkSession, path) -> DataFrame:
    """CSV without a header, epoch milliseconds; adds asset and month from the file name."""
    raw = spark.read.schema(RAW).csv(path, header=False)
    return raw.withColumns({"asset": asset_from_path(), "month": month_of_path(), "time": F.timestamp_millis("time")})


def write_trades(trades: DataFrame, path: str) -> None:
    """Snappy Parquet by asset and month, sorted by time so that row groups can be skipped.

    Dealt by ranges of time within the asset-months, so a busy month is written by several tasks, each a file of its own.
    """
    dealt = trades.repartitionByRange("asset", "month", "time", "id").sortWithinPartitions("asset", "month", "time", "id")
    dealt.write.mode("overwrite").option("compression", "snappy").partitionBy("asset", "month").parquet(path)


def stitch_sources(trades: DataFrame, source: str = "source", by_id: bool = False) -> DataFrame:
    """Of sources in rank order, only rows later than all earlier sources' latest time; by_id: only ids that no earlier source has."""
    if by_id:
        first = trades.groupBy("asset", "id").agg(F.min(source).alias(source))
        return trades.join(first, ["asset", "id", source], "left_semi").select(*trades.columns)
    ends = trades.groupBy("asset", source).agg(F.max("time").alias("last"))  # a row a source
    w = Window.partitionBy("asset").orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("after", F.max("last").over(w)).drop("last")
    joined = trades.join(ends, ["asset", source])
    return joined.where(F.col("after").isNull() | (F.col("time") > F.col("after"))).select(*trades.columns)


def scan_features(table: DataFrame, windows: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """I4: rows of any of the (first month, last month) windows, only these columns; the bounds reach the Parquet scan.

    A table that is partitioned by `month` (the first day, as a date) is also pruned by it.
    """
    kind, chosen, kept = dict(table.dtypes)["time"], F.lit(False), F.lit(False)
    for a, z in windows:
        start, stop = datetime.date.fromisoformat(f"{a}-01"), datetime.date.fromisoformat(f"{z}-01")
        stop = (stop + datetime.timedelta(days=32)).replace(day=1)
        chosen = chosen | ((F.col("time") >= F.lit(str(start)).cast(kind)) & (F.col("time") < F.lit(str(stop)).cast(kind)))
        kept = kept | ((F.col("month") >= F.lit(start)) & (F.col("month") < F.lit(stop)))
    if dict(table.dtypes).get("month") == "date":
        chosen = chosen & kept
    return table.where(chosen).select(*columns)


def scan_trades_window(trades: DataFrame, asset: str, start, end) -> DataFrame:
    """Trades of an asset in (start, end]; the bounds reach the Parquet scan."""
    return trades.where((F.col("asset") == asset) & (F.col("time") > F.lit(start)) & (F.col("time") <= F.lit(end)))


def checksum_audit(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest (file, sha256) against the files: OK, MISMATCH, or MISSING."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.lower("sha256"), "OK").otherwise("MISMATCH")
    return manifest.join(files, "file", "left").select("file", status.alias("status"))


def union_common_columns(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """I8: rows of all, with the columns that all have, in the first one's order."""
    common = [c for c in first.columns if all(c in x.columns for x in rest)]
    out = first.select(*common)
    for x in rest:
        out = out.unionByName(x.select(*common))
    return out


def pool_assets(table: DataFrame, assets: list[str]) -> DataFrame:
    """asset_id is the place in the configured list."""
    return table.withColumn("asset_id", (F.array_position(F.array(*map(F.lit, assets)), F.col("asset")) - 1).cast("int"))


def write_result(df: DataFrame, path: str) -> None:
    """A result table as Parquet and CSV."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").csv(f"{path}/csv", header=True)


def read_metrics_json(spark: SparkSession, path) -> DataFrame:
    """Files {model: {class: {precision, recall, f1-score}}} as rows."""
    scores = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", scores).alias("m"))
    by_class = raw.select("file", F.explode("m").alias("model", "c")).select("file", "model", F.explode("c").alias("class", "s"))
    return by_class.select("file", "model", "class", F.col("s")["precision"].alias("precision"), F.col("s")["recall"].alias("recall"), F.col("s")["f1-score"].alias("f1"))


def trade_stream(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Trades as files arrive, with the fixed schema and the asset."""
    return spark.readStream.schema(f"asset string, {TRADE}").format(format).load(path)
