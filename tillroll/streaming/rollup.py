"""Sales reports from a roll-up that every micro-batch brings up to date.

The input is a feed of bill changes: a bill with ``change`` +1 when it becomes completed, -1 when it is
voided, refunded or returned.  Per micro-batch the changes are summed per (hour, payment method)
and per (day, customer), added to the cells that the store holds, and committed with the batch id as the
offset.  Reports read cells instead of bills: at most 24 x methods a day, and for distinct customers
one row per customer and day, counted where its bills are not back to none.  Both aggregates can be taken back exactly,
which a bitmap of customers could not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ranges as R
from tillroll.sources.schema import TOTAL
from tillroll.streaming.store import Replace, Store, Update

_MONEY = ("net_amount", "tax_amount", "discount_amount")
_CELLS = "id string, hour timestamp_ntz, payment_method string, bills long, " + ", ".join(f"{c} {TOTAL.simpleString()}" for c in _MONEY)
_VISITS = "id string, day date, customer_id long, bills long"


def bill_changes(t) -> tuple[DataFrame, DataFrame]:
    """Every bill that ever was completed (+1), and those that no longer are (-1)."""
    cols = ["id", "created_at", "payment_method", "customer_id", *_MONEY]
    sold = t.bills.filter("status <> 'pending'").select(*cols, F.lit(1).alias("change"))
    back = t.bills.filter("status not in ('pending', 'completed')").select(*cols, F.lit(-1).alias("change"))
    return sold, back


def _added(store: Store, name: str, new: DataFrame, figures: list[str]) -> Update:
    """``new`` sums (id, other columns, figures) added to the cells of the same id."""
    held = store.lookup(name, new.select("id")).select("id", *[F.col(c).alias(f"_old_{c}") for c in figures])
    cols = [(F.col(c) + F.coalesce(f"_old_{c}", F.lit(0))).cast(new.schema[c].dataType).alias(c) if c in figures else F.col(c) for c in new.columns]
    return Update(new.join(held, "id", "left").select(*cols), insert=True)


def maintain(changes: DataFrame, root: str) -> Store:
    """Drain a stream of bill changes; a later run with the same root goes on."""
    spark = changes.sparkSession
    store = Store(spark, root)
    if store.latest() is None:
        store.write({"cells": Replace(spark.createDataFrame([], _CELLS)), "visits": Replace(spark.createDataFrame([], _VISITS))})
    n = F.col("change")

    def handle(batch: DataFrame, batch_id: int) -> None:
        offset = store.describe()["batch"]
        if offset is not None and offset >= batch_id:
            return
        batch = batch.persist()
        try:
            hour = F.date_trunc("HOUR", F.col("created_at")).cast("timestamp_ntz")
            method = F.coalesce(F.concat(F.lit("="), "payment_method"), F.lit(""))
            cells = batch.groupBy(F.concat_ws("|", hour.cast("string"), method).alias("id"), hour.alias("hour"), "payment_method").agg(
                F.sum(n).cast("long").alias("bills"), *[F.sum(n * F.col(c)).cast(TOTAL).alias(c) for c in _MONEY])
            day = F.to_date("created_at")
            visits = batch.filter("customer_id is not null").groupBy(
                F.concat_ws("|", day.cast("string"), F.col("customer_id").cast("string")).alias("id"), day.alias("day"),
                F.col("customer_id").cast("long").alias("customer_id")).agg(F.sum(n).cast("long").alias("bills"))
            store.write({"cells": _added(store, "cells", cells, ["bills", *_MONEY]), "visits": _added(store, "visits", visits, ["bills"])}, batch_id)
        finally:
            batch.unpersist()

    q = changes.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return store


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c).cast(TOTAL), F.lit(0).cast(TOTAL))


class Reports:
    """The reports of ``operators.reports`` over a roll-up's cells."""

    def __init__(self, store: Store):
        self.store = store

    def _cells(self, start, end=None) -> DataFrame:
        h = F.col("hour")
        inside = (h >= R.ts_lit(start)) if end is None else (h >= R.ts_lit(start)) & (h < R.ts_lit(end))
        return self.store.read("cells").filter(inside & (F.col("bills") != 0))

    def _figures(self, start, end=None, discounts: bool = True, avg: bool = True, tax: bool = True, customers: bool = False) -> DataFrame:
        n = F.coalesce(F.sum("bills"), F.lit(0).cast("long"))
        cols = [n.alias("total_transactions"), _total("net_amount").alias("total_revenue")]
        if tax:
            cols.append(_total("tax_amount").alias("total_tax"))
        if discounts:
            cols.append(_total("discount_amount").alias("total_discounts"))
        if avg:
            cols.append(F.coalesce(F.try_divide(F.sum("net_amount").cast("double"), F.sum("bills")), F.lit(0.0)).alias("avg_transaction_value"))
        out = self._cells(start, end).agg(*cols)
        if not customers:
            return out
        d = F.col("day")
        seen = self.store.read("visits").filter((F.col("bills") > 0) & (d >= F.to_date(R.ts_lit(start))) & (d < F.to_date(R.ts_lit(end))))
        both = out.unionByName(seen.agg(F.count_distinct("customer_id").alias("unique_customers")), allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])  # two rows, each with its own columns

    def dashboard_today(self, as_of) -> DataFrame:
        """C1."""
        return self._figures(R.day(as_of).start, R.day(as_of).end)

    def dashboard_week(self, as_of) -> DataFrame:
        """C2."""
        return self._figures(R.week_start(as_of), discounts=False, avg=False, tax=False)

    def dashboard_month(self, as_of) -> DataFrame:
        """C3."""
        return self._figures(R.month_start(as_of), discounts=False, avg=False, tax=False)

    def daily_summary(self, date) -> DataFrame:
        """C6."""
        return self._figures(R.day(date).start, R.day(date).end, customers=True)

    def daily_hourly(self, date) -> DataFrame:
        """C7."""
        return (self._cells(R.day(date).start, R.day(date).end).groupBy(F.hour("hour").cast("int").alias("hour"))
                .agg(F.sum("bills").alias("transactions"), _total("net_amount").alias("revenue")).orderBy("hour"))

    def daily_payment_mix(self, date) -> DataFrame:
        """C8."""
        return (self._cells(R.day(date).start, R.day(date).end).groupBy("payment_method")
                .agg(F.sum("bills").alias("count"), _total("net_amount").alias("amount")).orderBy(F.col("amount").desc(), "payment_method"))

    def weekly_by_day(self, week_start) -> DataFrame:
        """C10."""
        w = R.week(R.midnight(week_start))
        return (self._cells(w.start, w.end).groupBy(F.to_date("hour").alias("date"), F.rpad(F.date_format("hour", "EEEE"), 9, " ").alias("day_name"))
                .agg(F.sum("bills").alias("total_transactions"), _total("net_amount").alias("total_revenue"), _total("tax_amount").alias("total_tax"))
                .orderBy("date"))

    def weekly_totals(self, week_start) -> DataFrame:
        """C11."""
        w = R.week(R.midnight(week_start))
        return self._figures(w.start, w.end, discounts=False)

    def monthly_summary(self, year: int, month: int) -> DataFrame:
        """C12."""
        m = R.month(year, month)
        return self._figures(m.start, m.end, customers=True)

    def monthly_by_week(self, year: int, month: int) -> DataFrame:
        """C13."""
        m = R.month(year, month)
        return (self._cells(m.start, m.end).groupBy(F.date_trunc("week", "hour").cast("date").alias("week_start"))
                .agg(F.sum("bills").alias("transactions"), _total("net_amount").alias("revenue")).orderBy("week_start"))
