"""Streaming sinks and twins: idempotent snapshots, equality with batch under batch splits."""

import time

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.sources import mapping as M
from tillroll.streaming import live
from tillroll.streaming.sinks import commit_snapshot, last_committed, read_snapshot, run_update_stream, scratch


def test_snapshot_commit_is_all_or_nothing_and_replayable(spark):
    root = scratch(spark, "test-commit")
    commit_snapshot({"a": spark.range(3), "b": spark.range(2)}, root, 0)
    commit_snapshot({"a": spark.range(5), "b": spark.range(1)}, root, 0)      # replay of batch 0 overwrites
    spark.range(7).write.parquet(f"{root}/snapshots/a/batch_id=1")            # batch 1 never committed
    assert last_committed(spark, root) == 0
    assert read_snapshot(spark, root, "a").count() == 5
    assert read_snapshot(spark, root, "b").count() == 1


def _hourly_batch(orders):
    b = M.bills(orders).filter(F.col("status") == "completed")
    return b.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("net_amount").cast("decimal(18,2)").alias("revenue"))


def test_hourly_stream_equals_batch_when_batches_arrive_in_time_order(spark):
    src = scratch(spark, "test-orders")
    orders = M.read_raw(spark, SF_SMALL, "orders")
    created = M.bills(orders).select(F.col("id").alias("o_orderkey"), "created_at")
    o = orders.join(created, "o_orderkey")
    bounds = ["1997-01-01", "1998-07-01", "2000-01-01"]
    edges = [None] + bounds + [None]
    for i in range(len(edges) - 1):              # one file per time slice, written in time order
        part = o
        if edges[i]:
            part = part.filter(F.col("created_at") >= F.lit(edges[i]).cast("timestamp_ntz"))
        if edges[i + 1]:
            part = part.filter(F.col("created_at") < F.lit(edges[i + 1]).cast("timestamp_ntz"))
        part.drop("created_at").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_update_stream(live.hourly_revenue_stream(M.bills(stream)), ["hour_start"], scratch(spark, "test-s1"))
    want = _hourly_batch(orders)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_hourly_stream_drops_only_late_rows(spark):
    src = scratch(spark, "test-orders-shuffled")
    orders = M.read_raw(spark, SF_SMALL, "orders")
    orders.repartition(5, "o_orderkey").write.parquet(src)      # out of time order: later files hold old rows
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_update_stream(live.hourly_revenue_stream(M.bills(stream)), ["hour_start"], scratch(spark, "test-s1b"))
    want = _hourly_batch(orders).withColumnRenamed("transactions", "all_rows")
    j = got.join(want, "hour_start", "left")
    assert j.filter(F.col("all_rows").isNull() | (F.col("transactions") > F.col("all_rows"))).count() == 0


def test_windows_follow_wall_clock_in_any_session_zone(spark):
    from tillroll.streaming.live import _event_time, _wall_clock
    df = spark.createDataFrame([("2000-01-01 10:15:00",), ("2000-01-01 23:50:00",)], "s string") \
        .select(F.col("s").cast("timestamp_ntz").alias("created_at"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["UTC", "Asia/Kolkata", "America/New_York"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            ev = _event_time(df, "1 hour")
            for size, want in [("1 hour", ["2000-01-01 10:00:00", "2000-01-01 23:00:00"]),
                               ("1 day", ["2000-01-01 00:00:00", "2000-01-01 00:00:00"])]:
                got = ev.select(_wall_clock(F.window("event_time", size).start, tz).alias("w")).collect()
                assert sorted(str(r.w) for r in got) == want, (tz, size)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
