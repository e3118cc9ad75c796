"""Results written back: each operation's changed rows go into a versioned store as one version.

The operators of ``ledger`` and ``integrity`` return changed and new rows.  These functions
run them over a store's tables and write what they return, all tables of an operation together;
only files that hold a changed row are written anew.  A repeated ``batch`` changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import integrity, ledger
from tillroll.sources import schema as S
from tillroll.sources.catalog import Retail
from tillroll.streaming.sinks import kept
from tillroll.streaming.store import Append, Replace, Store, Update

#: What the files of a table are ranges of: its id, or for bill lines their bill's.
_KEYS = {n: next((c for c in ("id", "bill_id") if c in schema.names), None) for n, schema in S.SCHEMAS.items()}


def create(store: Store, t: Retail, names: list[str] | None = None) -> int:
    """The first version: the model tables of ``t``, in ranges of their keys.

    Keys are looked up first where one column tells them; those of returns may take a join, which is not done twice."""
    keys = lambda n: t.table(n).select(_KEYS[n]) if _KEYS.get(n) and n != "returns" else None
    return store.write({n: Replace(t.table(n), _KEYS.get(n), keys(n)) for n in names or S.SCHEMAS})


def catalog(store: Store, version: int | None = None) -> Retail:
    """The store's tables as a catalog (others are empty)."""
    tables = store.describe(version)["tables"]
    return Retail.from_frames(store.spark, {n: store.read(n, version) for n in tables})


def sales(store: Store, items: DataFrame, bills: DataFrame, batch: int | None = None) -> int:
    """Sold units leave the stock; points, lifetime purchases and tiers follow the bills."""
    t = catalog(store)
    stock = ledger.apply_sales(t.products, items).filter("changed").select("id", "stock_quantity")
    points = ledger.accrue_loyalty(t.customers, bills).filter("changed").select("id", "loyalty_points", "total_purchases", "loyalty_tier")
    return store.write({"products": Update(stock), "customers": Update(points)}, batch)


def voids(store: Store, requests: DataFrame, batch: int | None = None) -> int:
    """Bills voided, their stock and loyalty taken back."""
    t = catalog(store)
    # the bills to void are found once, for all three tables, by files whose size is known: joins with few rows need no shuffle
    asked = kept(requests.select("bill_id").distinct(), "void-requests")
    held = t.bills.select("id", "customer_id", "net_amount", "status").filter("status <> 'voided'")
    hit = kept(held.join(asked, held["id"] == asked["bill_id"], "left_semi"), "voided")
    bills, stock, points = ledger.void_bills(t.with_tables(bills=hit), hit.select(F.col("id").alias("bill_id")))
    return store.write({"bills": Update(bills.select("id", "status")), "products": Update(stock.select("id", "stock_quantity")),
                        "customers": Update(points.select("id", "loyalty_points", "total_purchases"))}, batch)


def returns(store: Store, requests: DataFrame, batch: int | None = None) -> int:
    """Accepted returns recorded, stock put back, bills partially returned."""
    t = catalog(store)
    checked = ledger.validate_returns(t, requests)
    _, stock, bills = ledger.apply_returns(t, checked)
    # the model's rows: one per returned product
    lines = checked.filter("reject_reason is null").select(
        F.col("request_id").alias("id"), "bill_id", "product_id", "quantity", F.round("amount_exact", 2).alias("return_amount"), "created_at")
    return store.write({"returns": Append(_as_model(lines, "returns")), "products": Update(stock.select("id", "stock_quantity")),
                        "bills": Update(bills)}, batch)


def payments(store: Store, requests: DataFrame, batch: int | None = None) -> int:
    """Payments recorded, their bills completed."""
    rows, bills = ledger.record_payments(catalog(store), requests)
    full = rows.withColumn("gateway_transaction_id", F.lit(None).cast("string"))
    return store.write({"payments": Append(_as_model(full, "payments")), "bills": Update(bills)}, batch)


def refunds(store: Store, requests: DataFrame, batch: int | None = None) -> int:
    """Refund rows added, their payments refunded."""
    rows, paid = ledger.refund_payments(catalog(store), requests)
    return store.write({"payments": _both(rows, paid, store)}, batch)


def adjustments(store: Store, steps: DataFrame, batch: int | None = None) -> int:
    """Accepted adjustments take effect in order; each product ends at its last balance."""
    done = ledger.adjust_stock(catalog(store), steps).filter("accepted")
    last = done.groupBy(F.col("product_id").alias("id")).agg(
        F.max_by("new_quantity", F.struct("created_at", done["id"])).cast("int").alias("stock_quantity"))
    return store.write({"products": Update(last)}, batch)


def redemptions(store: Store, requests: DataFrame, batch: int | None = None) -> int:
    """Granted redemptions take their points; tiers follow."""
    done = ledger.redeem_points(catalog(store), requests).filter("accepted")
    last = done.groupBy(F.col("customer_id").alias("id")).agg(
        F.max_by(F.struct("loyalty_points", "loyalty_tier"), F.struct("created_at", "request_id")).alias("s"))
    return store.write({"customers": Update(last.select("id", F.col("s.loyalty_points").cast("int").alias("loyalty_points"), "s.loyalty_tier"))}, batch)


def patch(store: Store, table: str, rows: DataFrame, columns: list[str], batch: int | None = None) -> int:
    """Non-null values of the patch set, the last patch of a key and column first."""
    out, _ = integrity.apply_patch(store.read(table), rows, "id", columns)
    return store.write({table: Update(out.filter("changed").select("id", *columns))}, batch)


def deactivate(store: Store, table: str, ids: DataFrame, batch: int | None = None) -> int:
    """Soft delete."""
    out = integrity.soft_delete(store.read(table), ids).filter("changed").select("id", "is_active")
    return store.write({table: Update(out)}, batch)


def insert(store: Store, table: str, rows: DataFrame, batch: int | None = None) -> int:
    """A2: rows whose id is new."""
    return store.write({table: Append(integrity.insert_absent(store.read(table), rows, ["id"]))}, batch)


def _as_model(rows: DataFrame, table: str) -> DataFrame:
    """The rows with all columns of a model table, absent ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in S.SCHEMAS[table].fields])


def _both(rows: DataFrame, paid: DataFrame, store: Store) -> Update:
    """New payments and changed ones in one change: the changed rows carry all their columns."""
    table = store.read("payments")
    changed = table.join(paid.select("id", F.col("status").alias("_to")), "id").withColumn("status", F.col("_to")).drop("_to")
    return Update(_as_model(rows, "payments").unionByName(changed.select(*[f.name for f in S.SCHEMAS["payments"].fields])), insert=True)
