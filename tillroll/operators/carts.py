"""Cart folding and last login from event streams.

D26 — the till's cart: ``add`` puts one more unit of a product in the cart,
``remove`` drops the product's line, and a later ``add`` starts again at 1.
So a line's final quantity is the number of adds after its last remove; the
total is Σ price × quantity without tax.  Per (cart, product) this is two
aggregates (last remove time, then adds after it) — no ordering of a whole
cart in one task, and partial aggregation absorbs a hot cart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.sources.schema import TOTAL


def cart_lines(events: DataFrame) -> DataFrame:
    """(cart_id, product_id, quantity) after folding add/remove events (ts, id order)."""
    key = ["cart_id", "product_id"]
    last_remove = events.filter(F.col("action") == "remove").groupBy(*key).agg(
        F.max(F.struct("ts", "id")).alias("_lr"))
    adds = events.filter(F.col("action") == "add").join(last_remove, key, "left")
    after = adds.filter(F.col("_lr").isNull() | (F.struct("ts", "id") > F.col("_lr")))
    return after.groupBy(*key).agg(F.count(F.lit(1)).alias("quantity"))


def fold_carts(events: DataFrame, products: DataFrame) -> DataFrame:
    """Per cart, lines, units and total (Σ price × quantity, no tax)."""
    lines = cart_lines(events)
    p = products.select(F.col("id").alias("_pid"), "price")
    j = lines.join(p, lines.product_id == p._pid, "inner")
    return j.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("bigint").alias("units"),
        F.sum(F.col("price") * F.col("quantity")).cast(TOTAL).alias("cart_total"))


def last_login(logins: DataFrame, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """The latest login per user, ready to patch ``users.last_login``."""
    return logins.groupBy(F.col(user_col).alias("id")).agg(F.max(ts_col).alias("last_login"))


def record_logins(users: DataFrame, logins: DataFrame, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """``users`` with ``last_login`` moved forward to each user's latest login; others keep theirs (null if none)."""
    last = last_login(logins, user_col, ts_col).select(F.col("id").alias("_uid"), F.col("last_login").alias("_at"))
    old = F.col("last_login") if "last_login" in users.columns else F.lit(None)
    j = users.join(last, users["id"] == last["_uid"], "left")
    return j.withColumn("last_login", F.greatest(old.cast("timestamp_ntz"), F.col("_at").cast("timestamp_ntz"))).drop("_uid", "_at")
