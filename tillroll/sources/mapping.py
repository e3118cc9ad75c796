"""Driver test tables (TPC-H-like) -> retail model tables.

Pure column expressions over the raw scans, so Catalyst prunes every column a
report does not use and nothing here leaves the JVM.  The derivation rules
are the fixed specification shared with the DuckDB oracle (tillroll.oracle).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources import schema as S

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(c: Column, p: int, s: int) -> Column:
    return c.cast(f"decimal({p},{s})")


def _tier(points: Column) -> Column:
    return (F.when(points >= 10000, "platinum").when(points >= 5000, "gold")
            .when(points >= 1000, "silver").otherwise("bronze"))


def departments(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    return nation.select(
        k.alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("description"),
        (k % 10).cast("int").alias("manager_id"), (k % 12 != 0).alias("is_active"),
        F.lit("1994-01-01 00:00:00").cast(S.TS).alias("created_at"))


def users(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.cast("int").alias("id"), F.concat(F.lit("User "), F.col("s_name")).alias("name"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@store.example")).alias("email"),
        F.when(k % 10 == 0, "admin").when((k % 10).isin(1, 2), "manager").otherwise("cashier").alias("role"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("s_nationkey")).cast("int").alias("department_id"),
        (k % 9 != 8).alias("is_active"))


def suppliers(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("contact"), k.cast("string"), F.lit("@supplier.example")).alias("contact_email"),
        (F.col("s_acctbal") >= 0).alias("is_active"))


def products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    size = F.col("p_size")
    return part.select(
        k.alias("id"), F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("name"),
        F.concat(F.lit("SKU"), k.cast("string")).alias("sku"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("890"), F.lpad(k.cast("string"), 10, "0"))).alias("barcode"),
        _dec(F.col("p_retailprice"), 12, 2).alias("price"),
        _dec(F.when(size % 4 == 0, 0).when(size % 4 == 1, 5).when(size % 4 == 2, 12).otherwise(18), 5, 2)
        .alias("tax_rate"),
        ((k * 37) % 101).cast("int").alias("stock_quantity"), size.alias("minimum_stock"),
        F.lit("piece").alias("unit"), F.col("p_type").alias("category"),
        F.when(F.col("p_brand") == "Brand#25", F.lit(None))
         .otherwise(F.substring("p_brand", 7, 20).cast("int") - 1).cast("int").alias("department_id"),
        (k % 10).alias("supplier_id"), (k % 20 != 0).alias("is_active"))


def customers(customer: DataFrame) -> DataFrame:
    points = F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") * 1.5)).otherwise(0).cast("int")
    base = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                           points.alias("loyalty_points"))
    k = F.col("id")
    return base.select(
        "id", "name",
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example"))).alias("email"),
        F.concat(F.lit("+91-"), F.lpad(k.cast("string"), 10, "0")).alias("phone"),
        "loyalty_points", _tier(F.col("loyalty_points")).alias("loyalty_tier"),
        _dec(F.col("loyalty_points") * 10, 14, 2).alias("total_purchases"),
        (k % 25 != 0).alias("is_active"))


# created_at = o_orderdate + [0, 86400) seconds, so a created_at window maps
# to an o_orderdate window one day wider: that bound is pushed to the scan.
CREATED_SPREAD = dt.timedelta(days=1)


def bills(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    net = _dec(F.col("o_totalprice"), 12, 2)
    tax = _dec(F.round(net * _dec(F.lit(0.05), 3, 2), 2), 12, 2)
    disc_rate = _dec(_dec(k % 5, 3, 0) * _dec(F.lit(0.01), 3, 2), 4, 2)
    disc = _dec(F.round(net * disc_rate, 2), 12, 2)
    prio = F.col("o_orderpriority")
    method = (F.when(prio == "1-URGENT", "cash").when(prio == "2-HIGH", "card").when(prio == "3-MEDIUM", "upi")
              .when(prio == "4-NOT SPECIFIED", "wallet").when(k % 2 == 0, "credit").otherwise("razorpay"))
    st = F.col("o_orderstatus")
    status = (F.when(st == "F", "completed")
              .when(st == "O", F.when(k % 3 == 0, "pending").otherwise("completed"))
              .when(k % 3 == 0, "voided").when(k % 3 == 1, "partially_returned").otherwise("refunded"))
    created = F.timestamp_add("SECOND", ((k * 7919) % 86400).cast("int"), F.col("o_orderdate"))
    x = orders.select(
        k.alias("id"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey")).cast("bigint").alias("customer_id"),
        (k % 10).cast("int").alias("cashier_id"), net.alias("net_amount"), tax.alias("tax_amount"),
        disc.alias("discount_amount"), method.alias("payment_method"), status.alias("status"),
        created.alias("created_at"))
    return x.select(
        "id",
        F.concat(F.lit("BILL-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-"),
                 F.lpad(F.col("id").cast("string"), 9, "0")).alias("bill_number"),
        "customer_id", "cashier_id",
        _dec(F.col("net_amount") - F.col("tax_amount") + F.col("discount_amount"), 12, 2).alias("total_amount"),
        "discount_amount", "tax_amount", "net_amount", "payment_method", "status", "created_at")


def bill_items(lineitem: DataFrame) -> DataFrame:
    x = lineitem.select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _dec(F.floor(F.col("l_extendedprice") / F.col("l_quantity")), 12, 2).alias("unit_price"),
        _dec(F.floor(F.col("l_extendedprice") * F.col("l_discount")), 12, 2).alias("discount"),
        _dec(F.col("l_tax") * 100, 5, 2).alias("tax_rate"))
    net = F.col("unit_price") * F.col("quantity") - F.col("discount")
    tax = F.round(net * F.col("tax_rate") * _dec(F.lit(0.01), 3, 2), 2)
    return x.select("bill_id", "product_id", "quantity", "unit_price", "discount", "tax_rate",
                    _dec(tax, 12, 2).alias("tax_amount"), _dec(net + tax, 12, 2).alias("total_price"))


def _gateway_id(b: DataFrame) -> Column:
    return F.when(b.payment_method == "razorpay", F.concat(F.lit("pay_"), b.id.cast("string")))


def payments(b: DataFrame) -> DataFrame:
    paid = b.filter(F.col("status").isin("completed", "partially_returned", "refunded")).select(
        F.col("id"), F.col("id").alias("bill_id"), F.col("net_amount").alias("amount"),
        F.col("payment_method").alias("method"),
        F.when(F.col("status") == "refunded", "refunded").otherwise("completed").alias("status"),
        _gateway_id(b).alias("gateway_transaction_id"), F.col("cashier_id").alias("processed_by"),
        F.col("created_at"))
    refunds = b.filter(F.col("status") == "refunded").select(
        (-F.col("id") - 1).alias("id"), F.col("id").alias("bill_id"),
        _dec(-F.col("net_amount"), 12, 2).alias("amount"), F.col("payment_method").alias("method"),
        F.lit("refunded").alias("status"), _gateway_id(b).alias("gateway_transaction_id"),
        F.col("cashier_id").alias("processed_by"),
        F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("created_at"))
    return paid.unionByName(refunds)


def returned_items(items: DataFrame) -> DataFrame:
    """The lines that come back when their bill is partially returned."""
    return items.filter(F.col("product_id") % 2 == 0)


def returns(b: DataFrame, items: DataFrame) -> DataFrame:
    partly = b.filter(F.col("status") == "partially_returned")
    # only the lines of these bills are aggregated, where the join by bill has put them
    per_product = (returned_items(items)
                   .join(partly.select(F.col("id").alias("bill_id")), "bill_id", "left_semi")
                   .groupBy("bill_id", "product_id")
                   .agg(F.sum("quantity").cast("int").alias("quantity"),
                        _dec(F.sum("total_price"), 12, 2).alias("return_amount")))
    rb = partly.select("id", "cashier_id", F.timestamp_add("DAY", F.lit(2), F.col("created_at")).alias("created_at"))
    return rb.join(per_product, rb.id == per_product.bill_id, "inner").select(
        rb.id, per_product.bill_id, rb.cashier_id, per_product.product_id, per_product.quantity,
        per_product.return_amount, rb.created_at)


def stock_adjustments(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("product_id"),
        (F.floor("value").cast("int") * F.when(et.isin("error", "purchase"), -1).otherwise(1)).alias("adjustment"),
        F.when(et == "view", "manual").when(et == "signup", "purchase").when(et == "error", "damage")
         .when(et == "click", "return").otherwise("audit").alias("type"),
        (F.col("user_id") % 10).cast("int").alias("adjusted_by"), F.col("ts").alias("created_at"))


def cart_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("cart_id"),
        (F.col("event_id") % 20).alias("product_id"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), "ts")
