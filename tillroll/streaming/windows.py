"""S1 and S2 as kept tables: windows in a store, brought up to date by every micro-batch, late rows included.

Spark's watermarked aggregates drop rows behind the watermark.  Here a micro-batch is summed
per window and added to the windows that the store already holds; the windows it
touches are looked up and written back in the same version as the batch's rows of the ``late`` table, which
lists every row that arrived behind the watermark (newest event time seen by earlier batches, less
``lateness``).  So late rows repair their windows, the side output says which did, and a replayed batch
changes nothing.  State is the store: a run with the root of an earlier one goes on where that stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.sources.schema import TOTAL
from tillroll.streaming.store import Append, Replace, Store, Update

_WINDOWS = f"window_id string, window_start timestamp_ntz, payment_method string, transactions long, revenue {TOTAL.simpleString()}"
_LATE = "id long, created_at timestamp_ntz, net_amount decimal(12,2), seen_until timestamp_ntz"


def maintain(bills: DataFrame, root: str, unit: str, by_method: bool = False, lateness: str = "1 hour") -> Store:
    """Drain a stream of bills into windows of one ``unit`` (``HOUR``, ``DAY``) of completed bills; returns their store."""
    spark = bills.sparkSession
    store = Store(spark, root)
    if store.latest() is None:
        store.write({"windows": Replace(spark.createDataFrame([], _WINDOWS)), "late": Replace(spark.createDataFrame([], _LATE))},
                    meta={"seen_until": None})

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = store.describe()
        if now["batch"] is not None and now["batch"] >= batch_id:
            return
        batch = batch.persist()
        try:
            seen = F.lit(now["meta"]["seen_until"]).cast("timestamp_ntz")
            late = batch.filter(F.col("created_at") < seen - F.expr(f"interval {lateness}")).select(
                "id", "created_at", "net_amount", seen.alias("seen_until"))
            newest = batch.agg(F.greatest(F.max("created_at"), seen).cast("string")).first()[0]
            added = _windows(batch, unit, by_method).alias("new")
            held = store.lookup("windows", added.select("window_id"), "window_id").alias("old")
            sums = added.join(held, "window_id", "left").select(
                "window_id", "new.window_start", "new.payment_method",
                (F.col("new.transactions") + F.coalesce("old.transactions", F.lit(0))).alias("transactions"),
                (F.col("new.revenue") + F.coalesce("old.revenue", F.lit(0))).cast(TOTAL).alias("revenue"))
            store.write({"windows": Update(sums, "window_id", insert=True), "late": Append(late)}, batch_id, {"seen_until": newest})
        finally:
            batch.unpersist()

    q = (bills.filter(F.col("status") == "completed").writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def _windows(bills: DataFrame, unit: str, by_method: bool) -> DataFrame:
    start: Column = F.date_trunc(unit, F.col("created_at")).cast("timestamp_ntz")
    method = F.col("payment_method") if by_method else F.lit(None).cast("string")
    # the id tells a null method from one of that name
    ident = F.concat_ws("|", start.cast("string"), F.coalesce(F.concat(F.lit("="), method), F.lit("")))
    return bills.groupBy(ident.alias("window_id"), start.alias("window_start"), method.alias("payment_method")).agg(
        F.count("*").alias("transactions"), F.sum("net_amount").cast(TOTAL).alias("revenue"))


def hourly_revenue(bills: DataFrame, root: str) -> DataFrame:
    """S1 with late rows: completed bills per hour."""
    return maintain(bills, root, "HOUR").read("windows").select(F.col("window_start").alias("hour_start"), "transactions", "revenue")


def payment_mix(bills: DataFrame, root: str) -> DataFrame:
    """S2 with late rows: completed bills per day and method."""
    return maintain(bills, root, "DAY", by_method=True).read("windows").select(
        F.col("window_start").alias("day_start"), "payment_method", F.col("transactions").alias("count"), F.col("revenue").alias("amount"))
