"""Batches through the stream equal the same rows at once; replays change nothing."""

import random

from pyspark.sql import functions as F
from tidepanel.operators import lifecycle
from tidepanel.streaming import daily


def test_daily_updates_keep_the_last_complete_dates(spark, tmp_path):
    rows = []
    for day in range(1, 13):
        for stock in range(6 if day != 5 else 2):
            rows.append((f"2024-01-{day:02d}", f"{stock:04d}", float(day), 0))
    rows += [("2024-01-10", "0001", 99.0, 1)]
    names = "date string, stock_id string, close double, seq long"
    whole = spark.createDataFrame(rows, names).withColumn("date", F.to_date("date"))
    for c in ("volume", "money", "open", "high", "low", "foreign_net", "trust_net", "dealer_net"):
        whole = whole.withColumn(c, F.lit(1.0))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for day in range(1, 13):
        whole.where(F.dayofmonth("date") == day).where("seq = 0").coalesce(1).write.mode("append").parquet(source)
    daily.run_updates(spark, source, state, str(tmp_path / "check"), keep_dates=4, least_stocks=5)
    whole.where("seq = 1").unionByName(whole.where("seq = 0 and dayofmonth(date) = 10")).coalesce(1).write.mode("append").parquet(source)
    daily.run_updates(spark, source, state, str(tmp_path / "check"), keep_dates=4, least_stocks=5)
    daily.run_updates(spark, source, state, str(tmp_path / "check"), keep_dates=4, least_stocks=5)
    got = daily.newest_state(spark, state).collect()
    assert sorted({r["date"].day for r in got}) == [9, 10, 11, 12] and len(got) == 24
    assert [r["close"] for r in got if r["date"].day == 10 and r["stock_id"] == "0001"] == [99.0]
    again = daily.apply_day(daily.newest_state(spark, state), daily.newest_state(spark, state), 4, 5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, [tuple(r[c] for c in again.columns) for r in got]))


def test_guard():
    assert daily.freshness_guard("2024-02-01", None, "2024-03-01") == "SEED_IN_FUTURE"
    assert daily.freshness_guard("2024-03-15", None, "2024-01-01") == "GAP_TOO_LONG"
    assert daily.freshness_guard("2024-01-05", "2024-01-03", "2024-01-03") == "ALREADY_CURRENT"
    assert daily.freshness_guard("2024-01-15", "2024-01-03", "2024-01-03") == "STALE"
    assert daily.freshness_guard("2024-01-05", "2024-01-05", "2024-01-03") == "UPDATE"


def test_streamed_lifecycle_equals_replay(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"{s:04d}", i, float(rng.choice([40, 79, 82, 85, 91, 96]))) for s in range(4) for i in range(90) if rng.random() > 0.1]
    rows += [(f"{s:04d}", 90, 10.0) for s in range(4)]
    schema = "stock_id string, idx long, score double"
    source = str(tmp_path / "scores")
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 31 == part], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = daily.lifecycle_stream(stream).writeStream.format("memory").queryName("lifecycle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("lifecycle").select("stock_id", "idx", "start_idx", "type").collect()))
    want = sorted(map(tuple, lifecycle.replay(spark.createDataFrame(rows, schema), lifecycle.layout_day_merged, "P").select("stock_id", "idx", "start_idx", "type").collect()))
    assert got == want and len(want) > 20
