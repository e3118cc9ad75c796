"""A1: the retail catalog — the eleven model tables behind one object.

``Retail.from_testdata`` maps the driver's TPC-H-like tables; ``Retail.from_model``
reads model tables written as Parquet (one folder per table, e.g. by the
snapshot sink).  Reports receive a ``Retail`` and ask it for bills in a time
window, so the catalog can push the window into the scan: on model Parquet the
``created_at`` predicate itself is pushed; on the mapped test tables an
equivalent one-day-wider bound on ``o_orderdate`` is added.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources import mapping as M
from tillroll.sources import schema as S


def _ts(v) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v))


def _lit_ts(v) -> Column:
    """A timestamp_ntz literal built from text, so no time zone is involved."""
    return F.lit(_ts(v).isoformat(sep=" ")).cast(S.TS)


class Retail:
    def __init__(self, spark: SparkSession, loader, raw_orders=None, raw=None):
        self.spark = spark
        self._raw = raw                  # name -> raw driver table, test tables only
        self._loader = loader            # name -> DataFrame
        self._raw_orders = raw_orders    # () -> raw orders DataFrame, test tables only
        self._cache: dict[str, DataFrame] = {}
        self._monthly_bills = None       # () -> bills with their month, bucketed tables only

    # -- construction -----------------------------------------------------
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Retail":
        raw = lambda n: M.read_raw(spark, sf_dir, n)

        def load(name: str) -> DataFrame:
            if name == "departments":
                return M.departments(raw("nation"))
            if name in ("users", "suppliers"):
                return getattr(M, name)(raw("supplier"))
            if name == "products":
                return M.products(raw("part"))
            if name == "customers":
                return M.customers(raw("customer"))
            if name == "bills":
                return M.bills(raw("orders"))
            if name == "bill_items":
                return M.bill_items(raw("lineitem"))
            if name == "payments":
                return M.payments(load("bills"))
            if name == "returns":
                return M.returns(load("bills"), load("bill_items"))
            if name in ("stock_adjustments", "cart_events"):
                return getattr(M, name)(raw("events"))
            raise KeyError(name)

        out = cls(spark, load, raw_orders=lambda: raw("orders"), raw=raw)
        out.sf_dir = sf_dir
        return out

    @classmethod
    def from_model(cls, spark: SparkSession, model_dir: str) -> "Retail":
        def load(name: str) -> DataFrame:
            return spark.read.schema(S.SCHEMAS[name]).parquet(f"{model_dir.rstrip('/')}/{name}")
        return cls(spark, load)

    @classmethod
    def from_tables(cls, spark: SparkSession, database: str) -> "Retail":
        """The bucketed tables that ``save_tables`` wrote into ``database``."""
        def load(name: str) -> DataFrame:
            return spark.table(f"{database}.{name}").select(*S.SCHEMAS[name].names)

        out = cls(spark, load)
        out._monthly_bills = lambda: spark.table(f"{database}.bills")
        return out

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Retail":
        def load(name: str) -> DataFrame:
            if name in frames:
                return frames[name]
            return spark.createDataFrame([], S.SCHEMAS[name])
        return cls(spark, load)

    def with_tables(self, **frames: DataFrame) -> "Retail":
        """A catalog that replaces some tables (e.g. after a batch of writes)."""
        base = self

        def load(name: str) -> DataFrame:
            return frames[name] if name in frames else base.table(name)
        return Retail(self.spark, load, raw_orders=None if "bills" in frames else self._raw_orders, raw=self._raw)

    # -- access -------------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        """A raw driver table (request streams are derived from these)."""
        if self._raw is None:
            raise KeyError(f"no raw table {name!r} in this catalog")
        return self._raw(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in S.SCHEMAS}

    departments = cached_property(lambda self: self.table("departments"))
    users = cached_property(lambda self: self.table("users"))
    suppliers = cached_property(lambda self: self.table("suppliers"))
    products = cached_property(lambda self: self.table("products"))
    customers = cached_property(lambda self: self.table("customers"))
    bills = cached_property(lambda self: self.table("bills"))
    bill_items = cached_property(lambda self: self.table("bill_items"))
    payments = cached_property(lambda self: self.table("payments"))
    returns = cached_property(lambda self: self.table("returns"))
    stock_adjustments = cached_property(lambda self: self.table("stock_adjustments"))
    cart_events = cached_property(lambda self: self.table("cart_events"))

    def bills_window(self, start=None, end=None, end_inclusive: bool = False,
                     status: str | None = None) -> DataFrame:
        """Bills with ``start <= created_at < end`` (``<= end`` when inclusive).

        Either bound may be None.  On the mapped test tables the same window,
        widened by the creation-time spread, also filters ``o_orderdate`` in
        the scan so Parquet row groups outside it are skipped.
        """
        if self._raw_orders is not None and (start is not None or end is not None):
            o = self._raw_orders()
            if start is not None:
                o = o.filter(F.col("o_orderdate") > _lit_ts(_ts(start) - M.CREATED_SPREAD))
            if end is not None:
                o = o.filter(F.col("o_orderdate") <= _lit_ts(end))
            b = M.bills(o)
        elif self._monthly_bills is not None:
            b = self._monthly_bills()  # months outside the window are not listed
            if start is not None:
                b = b.filter(F.col("month") >= _ts(start).strftime("%Y-%m"))
            if end is not None:
                b = b.filter(F.col("month") <= _ts(end).strftime("%Y-%m"))
            b = b.select(*S.SCHEMAS["bills"].names)
        else:
            b = self.bills
        if start is not None:
            b = b.filter(F.col("created_at") >= _lit_ts(start))
        if end is not None:
            c = F.col("created_at")
            b = b.filter(c <= _lit_ts(end) if end_inclusive else c < _lit_ts(end))
        if status is not None:
            b = b.filter(F.col("status") == status)
        return b


#: What the large tables are bucketed and sorted by: a bill's rows of all of them share a bucket number.
BUCKET_KEYS = {"bills": "id", "bill_items": "bill_id", "payments": "bill_id", "returns": "bill_id"}


def save_tables(t: Retail, database: str, buckets: int, location: str | None = None) -> None:
    """Write the model as tables of ``database`` (created if absent: at ``location``, else in the warehouse).

    Bills, their lines, payments and returns are bucketed by bill id into the same number of buckets, so joins
    and aggregates by bill need no shuffle of lines; bills are partitioned by month as well, so a
    report lists only its months.  Size ``buckets`` for about 128-256 MB of lines each.  One file per bucket (and month): rows
    meet their bucket in one shuffle before the write."""
    spark = t.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    for name in S.SCHEMAS:
        df, key = t.table(name), BUCKET_KEYS.get(name)
        if key is None:
            df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
            continue
        df = df.repartition(buckets, key)
        writer = df.write
        if name == "bills":
            writer = df.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.partitionBy("month")
        writer.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(f"{database}.{name}")
