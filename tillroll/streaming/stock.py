"""S3: low-stock alerts from per-product state, the same however the movements fall into micro-batches.

A store keeps, per product, the balance as of a mark in event time, and the movements that are newer
than the mark.  A micro-batch moves the mark to the newest time seen less ``delay`` and settles, in event order, what has come
before it: a running sum per product from its kept balance (split by day) gives every balance, and an alert is raised for each
movement that takes a product from above its minimum to the minimum or below.  Balances of the products
concerned, the waiting movements, the alerts and the mark are one version of the store.  Nothing else is read again, so
the work follows the batch and what waits.

As long as no movement comes later than ``delay`` behind the newest, alerts depend on the movements alone.  One that does is
listed in ``late`` and settled with the next ones, as of its own time but after the mark.  ``finish`` settles what still waits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.plans.sequence import running_sum
from tillroll.plans.spread import parts_for, rows_read, spread
from tillroll.streaming.store import Append, Replace, Store, Update

EVENTS = "product_id long, created_at timestamp_ntz, kind int, ref long, delta long"
_ORDER = ["created_at", "kind", "ref"]


def stock_events(t) -> DataFrame:
    """Every movement of stock: sales (kind 0) and returns (1) by bill, adjustments (2) by their id.  Voided bills move nothing."""
    b = t.bills.filter(F.col("status") != "voided").select(F.col("id").alias("_bid"), "created_at")
    parts = parts_for(t.bill_items, rows_read(t.bill_items))
    lines = spread(t.bill_items.select("bill_id", "product_id", "quantity"), parts, "bill_id")
    sold = lines.join(b, F.col("bill_id") == F.col("_bid")).groupBy("product_id", "created_at", F.col("bill_id").alias("ref")).agg(
        (-F.sum("quantity")).alias("delta")).withColumn("kind", F.lit(0))
    back = t.returns.groupBy("product_id", "created_at", F.col("bill_id").alias("ref")).agg(F.sum("quantity").alias("delta")).withColumn("kind", F.lit(1))
    adjusted = t.stock_adjustments.select("product_id", "created_at", F.col("id").alias("ref"), F.col("adjustment").alias("delta"), F.lit(2).alias("kind"))
    rows = sold.unionByName(back).unionByName(adjusted)
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in EVENTS.split(", ")])


def event_files(events: DataFrame, folder: str, files: int) -> DataFrame:
    """The events written in ranges of their time, and read as a stream of files."""
    events.repartitionByRange(files, "created_at").write.parquet(folder)
    return events.sparkSession.readStream.schema(EVENTS).parquet(folder)


def _settle(store: Store, rows: DataFrame, mark, batch: int | None) -> None:
    """Settle ``rows`` and the waiting ones up to ``mark`` (None: all); the rest goes on waiting."""
    waiting = store.read("waiting").unionByName(rows.select(*store.read("waiting").columns))
    ready = waiting if mark is None else waiting.filter(F.col("created_at") <= F.lit(mark).cast("timestamp_ntz"))
    rest = waiting.limit(0) if mark is None else waiting.filter(F.col("created_at") > F.lit(mark).cast("timestamp_ntz"))
    n = rows.count() + sum(f["rows"] for f in store.describe()["tables"]["waiting"]["files"])
    held = store.lookup("balances", ready.select(F.col("product_id").alias("id")))
    run = running_sum(ready, "product_id", _ORDER, "delta", F.to_date("created_at"), out="_run", rows=n).join(
        held, F.col("product_id") == F.col("id")).withColumn("now", F.col("balance") + F.col("_run"))
    crossed = (F.col("now") - F.col("delta") > F.col("minimum_stock")) & (F.col("now") <= F.col("minimum_stock"))
    alerts = run.filter(crossed).select("product_id", "created_at", "kind", "ref", F.col("now").alias("balance"))
    moved = ready.groupBy(F.col("product_id").alias("_pid")).agg(F.sum("delta").alias("_sum"))
    after = held.join(moved, held.id == moved._pid).select("id", (F.col("balance") + F.col("_sum")).alias("balance"))
    before = store.describe()["meta"]["mark"]
    late = rows.filter(F.col("created_at") <= F.lit(before).cast("timestamp_ntz"))
    store.write({"waiting": Replace(rest), "balances": Update(after), "alerts": Append(alerts), "late": Append(late.select(*rest.columns))},
                batch, {"mark": before if mark is None else mark})


def monitor(events: DataFrame, products: DataFrame, root: str, delay: str = "1 day", files: int = 4) -> Store:
    """Drain a stream of events under a root; a later run with the same root goes on."""
    spark = products.sparkSession
    store = Store(spark, root)
    if store.latest() is None:
        opening = products.select(F.col("id").cast("long").alias("id"), F.col("stock_quantity").cast("long").alias("balance"),
                                  F.col("minimum_stock").cast("long").alias("minimum_stock"))
        nothing = spark.createDataFrame([], EVENTS)
        alerts = spark.createDataFrame([], "product_id long, created_at timestamp_ntz, kind int, ref long, balance long")
        store.write({"balances": Replace(opening, "id"), "waiting": Replace(nothing), "alerts": Replace(alerts), "late": Replace(nothing)},
                    meta={"mark": None})

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = store.describe()
        if now["batch"] is not None and now["batch"] >= batch_id:
            return
        batch = batch.persist()
        try:
            old = F.lit(now["meta"]["mark"]).cast("timestamp_ntz")
            mark = batch.agg(F.greatest(F.max("created_at") - F.expr(f"interval {delay}"), old).cast("string")).first()[0]
            if mark is not None:
                _settle(store, batch, mark, batch_id)
        finally:
            batch.unpersist()

    q = (events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def finish(store: Store) -> Store:
    """Settle the movements that still wait (the stream has ended)."""
    _settle(store, store.read("waiting").limit(0), None, None)
    return store
