"""Readers and writers on small files."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from tidewatch.operators import audit
from tidewatch.sources import trades as io
from tidewatch.streaming import live

START = 1_651_363_200_000  # 2022-05-01 UTC, in ms


def csv(folder, asset="BTCUSDT", n=6):
    path = folder / f"{asset}-trades-2022-05.csv"
    path.write_text("".join(f"{k},{100 + k}.5,0.5,{50 + k}.25,{START + 1000 * k},{'true' if k % 2 else 'false'},true\n" for k in range(n)))
    return path


def test_csv_to_parquet(spark, tmp_path):
    csv(tmp_path), csv(tmp_path, "ETHUSDT", 3)
    t = io.read_trades_csv(spark, f"file://{tmp_path}/*.csv")
    assert {(r.asset, str(r.month), r["count"]) for r in t.groupBy("asset", "month").count().collect()} == {("BTCUSDT", "2022-05-01", 6), ("ETHUSDT", "2022-05-01", 3)}
    assert t.agg(F.unix_micros(F.max("time"))).first()[0] == (START + 5000) * 1000
    for _ in range(2):
        io.write_trades(t, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select(t.columns).collect())) == sorted(map(tuple, t.collect()))
    assert io.write_trades(t.limit(0), f"file://{tmp_path}/none") is None


def test_scan_prunes(spark, tmp_path):
    days = spark.sql("SELECT explode(sequence(timestamp'2022-01-31 23:59:59', timestamp'2022-07-01 00:00:00', interval 1 day)) AS time").withColumns({"month": F.to_date(F.trunc("time", "month")), "v": F.lit(1), "w": F.lit(2)})
    days.write.partitionBy("month").parquet(f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    got = io.scan_features(table, [("2022-02", "2022-03"), ("2022-06", "2022-06")], ["time", "v"])
    assert {r.m for r in got.select(F.date_format("time", "yyyy-MM").alias("m")).collect()} == {"2022-02", "2022-03", "2022-06"}
    assert got.count() == 28 + 31 + 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((((month" in plan or "PartitionFilters: [(((month" in plan
    assert "GreaterThanOrEqual(time" in plan and "w#" not in plan
    assert io.scan_features(table, [], ["v"]).count() == 0


def test_checksums(spark, tmp_path):
    data = csv(tmp_path).read_bytes()
    csv(tmp_path, "ETHUSDT", 3)
    manifest = [("BTCUSDT-trades-2022-05.csv", hashlib.sha256(data).hexdigest().upper()), ("ETHUSDT-trades-2022-05.csv", "0" * 64), ("SOLUSDT-trades-2022-05.csv", "0" * 64)]
    got = io.checksum_audit(spark, f"file://{tmp_path}/*.csv", spark.createDataFrame(manifest, "file string, sha256 string")).collect()
    assert {r.file[:3]: r.status for r in got} == {"BTC": "OK", "ETH": "MISMATCH", "SOL": "MISSING"}


def test_results_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    io.write_result(rows, f"file://{tmp_path}/r")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/r/parquet").collect())) == [("a", 1.5), ("b", None)]
    assert spark.read.csv(f"file://{tmp_path}/r/csv", header=True).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"lr": {"stress": {"precision": 0.5, "recall": 0.25, "f1-score": 1 / 3}, "calm": {"precision": 1.0}}}))
    got = {(r.model, r["class"]): (r.precision, r.recall, r.f1) for r in io.read_metrics_json(spark, f"file://{tmp_path}/m.json").collect()}
    assert got == {("lr", "stress"): (0.5, 0.25, 1 / 3), ("lr", "calm"): (1.0, None, None)}


def test_late_trades_are_dropped_from_the_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2022, 5, 1) + datetime.timedelta(seconds=s)
    names = "asset string, id long, price double, qty double, quote_qty double, time timestamp, is_buyer_maker boolean, is_best_match boolean"
    (tmp_path / "in").mkdir()
    source = f"file://{tmp_path}/in"
    batches = ([(0, 1), (1, 5), (2, 120)], [(3, 2), (4, 125), (5, 300)])  # the trade 3 comes after the watermark passed it
    stream = live.stream_bars(io.trade_stream(spark, source))
    for rows in batches:
        spark.createDataFrame([("A", i, 1.0 + i, 1.0, 1.0 + i, at(s), False, True) for i, s in rows], names).coalesce(1).write.mode("append").parquet(source)
        live.sink(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").select("time", "volume", "price").collect()))
    assert [(v, p) for _, v, p in got] == [(2.0, 2.0), (2.0, 5.0)]


def test_summary_counts_null_prices_as_bad(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, 2.0, 1.0), (2, at, 0.0, 1.0), (3, at, -1.0, 0.0), (4, at, None, 1.0), (5, at, 3.0, None)]
    r = audit.trade_summary(spark.createDataFrame(rows, "id long, time timestamp_ntz, price double, qty double").withColumn("asset", F.lit("A"))).first()
    assert (r.trades, r.bad_price, r.bad_qty) == (5, 3, 2)
