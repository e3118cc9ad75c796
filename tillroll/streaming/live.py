"""The live figures as Structured Streaming aggregates.

Sources are the driver's tables read as file streams (the folder plus a
``pathGlobFilter`` naming the table), mapped with the same column rules as
the batch model.  Event time is ``created_at`` turned into the instant whose UTC
wall clock it is (the watermark refuses ``timestamp_ntz``), whatever the
session zone, and windows are reported back as ``timestamp_ntz`` wall clock.
Rows later than the watermark are dropped by design; on one drained input
each aggregate equals its batch twin.  A run with the ``root`` of an earlier one goes on where that stopped.
``streaming.windows`` keeps S1 and S2 exact with late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources import mapping as M
from tillroll.sources.schema import TOTAL
from tillroll.streaming.sinks import run_update_stream, scratch


def raw_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    schema = M.read_raw(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def shuffled_bills_stream(t, folder: str, files: int = 8, max_files: int = 2) -> DataFrame:
    """The bills written to ``folder`` as files that each hold all times, read as a stream of several micro-batches."""
    t.bills.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(files))).repartition(files, "_part").drop("_part").write.parquet(folder)
    return t.spark.readStream.schema(t.bills.schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def bills_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bills(raw_stream(spark, sf_dir, "orders"))


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def _event_time(b: DataFrame, watermark: str) -> DataFrame:
    """Event time = the instant whose UTC wall clock is ``created_at``, in any session
    zone, so epoch-aligned windows are the wall-clock hours and days."""
    ev = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), _session_tz(b))
    return b.withColumn("event_time", ev).withWatermark("event_time", watermark)


def _wall_clock(start: F.Column, tz: str) -> F.Column:
    """A window bound back to the ``timestamp_ntz`` wall clock it stands for."""
    return F.to_utc_timestamp(start, tz).cast("timestamp_ntz")


def hourly_revenue_stream(bills: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """S1 (twin of C7 over all days): completed bills per hour window."""
    b = _event_time(bills.filter(F.col("status") == "completed"), watermark)
    return b.groupBy(F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("net_amount").cast(TOTAL).alias("revenue")
    ).select(_wall_clock(F.col("w.start"), _session_tz(bills)).alias("hour_start"), "transactions", "revenue")


def payment_mix_stream(bills: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """S2 (twin of C8 over all days): completed bills per day window and method."""
    b = _event_time(bills.filter(F.col("status") == "completed"), watermark)
    return b.groupBy(F.window("event_time", "1 day").alias("w"), "payment_method").agg(
        F.count(F.lit(1)).alias("count"), F.sum("net_amount").cast(TOTAL).alias("amount")
    ).select(_wall_clock(F.col("w.start"), _session_tz(bills)).alias("day_start"), "payment_method", "count",
             "amount")


def stock_delta_stream(spark: SparkSession, sf_dir: str, bills: DataFrame) -> DataFrame:
    """S3 input: one stream of (product_id, delta).

    Every bill's lines leave the stock when it is written.  A void brings all its lines back (D8), a
    partial return those that were returned (D11); adjustments count as they are.  The bill's
    state comes from a stream–static join on the bill key."""
    lines = M.bill_items(raw_stream(spark, sf_dir, "lineitem"))
    state = bills.select(F.col("id").alias("_bid"), "status")
    sold = lines.join(state, lines.bill_id == state._bid, "inner")
    q = F.col("quantity").cast("bigint")
    sales = sold.select("product_id", (-q).alias("delta"))
    voids = sold.filter(F.col("status") == "voided").select("product_id", q.alias("delta"))
    returns = M.returned_items(sold.filter(F.col("status") == "partially_returned")).select("product_id", q.alias("delta"))
    adj = M.stock_adjustments(raw_stream(spark, sf_dir, "events")).select(
        "product_id", F.col("adjustment").cast("bigint").alias("delta"))
    return sales.unionByName(voids).unionByName(returns).unionByName(adj)


def stock_balance(spark: SparkSession, sf_dir: str, t, root: str | None = None) -> DataFrame:
    """S3: running stock per product from sales, voids, returns and adjustments.

    Each micro-batch compares the new balances of the products it changed
    with their balances after the previous batches (the last snapshot) and
    writes a low-stock alert for every product that crossed to
    ``<= minimum_stock``; alerts land in ``<out>/alerts/batch_id=<n>`` so a
    replayed batch rewrites its own alerts.  Returns the final balances with
    ``low_stock_alert`` = an alert was raised in some batch."""
    deltas = stock_delta_stream(spark, sf_dir, t.bills)
    agg = deltas.groupBy("product_id").agg(F.sum("delta").alias("delta"))
    out = root or scratch(spark, "s03-stock")
    p = t.products.select(F.col("id").alias("_pid"), "stock_quantity", "minimum_stock")

    def alerts(batch: DataFrame, batch_id: int) -> None:
        # this batch's own rows are already written, so the folder is there
        prev = (spark.read.parquet(f"{out}/data").filter(F.col("batch_id") < batch_id)
                .groupBy("product_id").agg(F.max_by("delta", "batch_id").alias("_prev")))
        j = batch.join(prev, "product_id", "left").join(p, F.col("product_id") == p._pid, "inner")
        before = F.col("stock_quantity") + F.coalesce("_prev", F.lit(0))
        after = F.col("stock_quantity") + F.col("delta")
        j.filter((before > F.col("minimum_stock")) & (after <= F.col("minimum_stock"))).select(
            "product_id", after.cast("bigint").alias("balance"), "minimum_stock", F.lit(batch_id).alias("raised_in")
        ).write.mode("overwrite").parquet(f"{out}/alerts/batch_id={batch_id}")

    cur = run_update_stream(agg, ["product_id"], out, on_batch=alerts)
    raised = spark.read.parquet(f"{out}/alerts").select(F.col("product_id").alias("_ap")).distinct()
    j = cur.join(p, cur.product_id == p._pid, "inner").join(raised, F.col("product_id") == raised._ap, "left")
    bal = (F.col("stock_quantity") + F.col("delta")).cast("bigint")
    return j.select("product_id", F.col("delta").cast("bigint").alias("delta"), bal.alias("balance"),
                    F.col("_ap").isNotNull().alias("low_stock_alert"))


def loyalty_stream(bills: DataFrame) -> DataFrame:
    """S4 input: points and spend per customer from completed bills (floor per bill)."""
    b = bills.filter((F.col("status") == "completed") & F.col("customer_id").isNotNull())
    return b.groupBy("customer_id").agg(
        F.sum(F.floor(F.col("net_amount") / 10).cast("bigint")).alias("points_added"),
        F.sum("net_amount").alias("spent"))


def loyalty(spark: SparkSession, sf_dir: str, t, root: str | None = None) -> DataFrame:
    """customers' points, lifetime spend and tier as bills stream in."""
    from tillroll.functions.loyalty import tier
    cur = run_update_stream(loyalty_stream(bills_stream(spark, sf_dir)), ["customer_id"],
                            root or scratch(spark, "s04-loyalty"))
    c = t.customers
    j = c.join(cur, c.id == cur.customer_id, "inner")
    pts = (F.col("loyalty_points") + F.col("points_added")).cast("int")
    return j.select("id", F.col("points_added").cast("bigint").alias("points_added"), pts.alias("loyalty_points"),
                    (F.col("total_purchases") + F.col("spent")).cast("decimal(14,2)").alias("total_purchases"),
                    tier(pts).alias("loyalty_tier"))


def hourly_revenue(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    s = hourly_revenue_stream(bills_stream(spark, sf_dir))
    return run_update_stream(s, ["hour_start"], root or scratch(spark, "s01-hourly"))


def payment_mix(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    s = payment_mix_stream(bills_stream(spark, sf_dir))
    return run_update_stream(s, ["day_start", "payment_method"], root or scratch(spark, "s02-mix"))
