"""Typed retail data model: one StructType per table, plus the accepted values.

Money is always decimal, never double.  Keys are integral (the mapped test
tables) but nothing below depends on that.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)        # prices, line and bill amounts
LIFETIME = T.DecimalType(14, 2)     # customers.total_purchases
RATE = T.DecimalType(5, 2)          # tax percent
TOTAL = T.DecimalType(18, 2)        # every report SUM is cast to this
TS = T.TimestampNTZType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DEPARTMENTS = _s(("id", T.IntegerType()), ("name", T.StringType()), ("description", T.StringType()),
                 ("manager_id", T.IntegerType()), ("is_active", T.BooleanType()), ("created_at", TS))
USERS = _s(("id", T.IntegerType()), ("name", T.StringType()), ("email", T.StringType()),
           ("role", T.StringType()), ("department_id", T.IntegerType()), ("is_active", T.BooleanType()))
SUPPLIERS = _s(("id", T.LongType()), ("name", T.StringType()), ("contact_email", T.StringType()),
               ("is_active", T.BooleanType()))
PRODUCTS = _s(("id", T.LongType()), ("name", T.StringType()), ("sku", T.StringType()), ("barcode", T.StringType()),
              ("price", MONEY), ("tax_rate", RATE), ("stock_quantity", T.IntegerType()),
              ("minimum_stock", T.IntegerType()), ("unit", T.StringType()), ("category", T.StringType()),
              ("department_id", T.IntegerType()), ("supplier_id", T.LongType()), ("is_active", T.BooleanType()))
CUSTOMERS = _s(("id", T.LongType()), ("name", T.StringType()), ("email", T.StringType()), ("phone", T.StringType()),
               ("loyalty_points", T.IntegerType()), ("loyalty_tier", T.StringType()),
               ("total_purchases", LIFETIME), ("is_active", T.BooleanType()))
BILLS = _s(("id", T.LongType()), ("bill_number", T.StringType()), ("customer_id", T.LongType()),
           ("cashier_id", T.IntegerType()), ("total_amount", MONEY), ("discount_amount", MONEY),
           ("tax_amount", MONEY), ("net_amount", MONEY), ("payment_method", T.StringType()),
           ("status", T.StringType()), ("created_at", TS))
BILL_ITEMS = _s(("bill_id", T.LongType()), ("product_id", T.LongType()), ("quantity", T.IntegerType()),
                ("unit_price", MONEY), ("discount", MONEY), ("tax_rate", RATE), ("tax_amount", MONEY),
                ("total_price", MONEY))
PAYMENTS = _s(("id", T.LongType()), ("bill_id", T.LongType()), ("amount", MONEY), ("method", T.StringType()),
              ("status", T.StringType()), ("gateway_transaction_id", T.StringType()),
              ("processed_by", T.IntegerType()), ("created_at", TS))
RETURNS = _s(("id", T.LongType()), ("bill_id", T.LongType()), ("cashier_id", T.IntegerType()),
             ("product_id", T.LongType()), ("quantity", T.IntegerType()), ("return_amount", MONEY), ("created_at", TS))
STOCK_ADJUSTMENTS = _s(("id", T.LongType()), ("product_id", T.LongType()), ("adjustment", T.IntegerType()),
                       ("type", T.StringType()), ("adjusted_by", T.IntegerType()), ("created_at", TS))
CART_EVENTS = _s(("id", T.LongType()), ("cart_id", T.LongType()), ("product_id", T.LongType()),
                 ("action", T.StringType()), ("ts", TS))

SCHEMAS = {
    "departments": DEPARTMENTS, "users": USERS, "suppliers": SUPPLIERS, "products": PRODUCTS,
    "customers": CUSTOMERS, "bills": BILLS, "bill_items": BILL_ITEMS, "payments": PAYMENTS,
    "returns": RETURNS, "stock_adjustments": STOCK_ADJUSTMENTS, "cart_events": CART_EVENTS,
}

# The accepted values of the enum-by-CHECK columns.
ROLES = ["admin", "manager", "cashier"]
TIERS = ["bronze", "silver", "gold", "platinum"]
BILL_METHODS = ["cash", "card", "upi", "wallet", "credit", "razorpay"]
ORDER_METHODS = ["cash", "card", "upi", "wallet", "credit"]          # accepted when a bill is created
RECORD_METHODS = ["cash", "card", "upi", "wallet"]                   # accepted when a payment is recorded
BILL_STATUSES = ["pending", "completed", "voided", "refunded", "partially_returned"]
PAYMENT_STATUSES = ["pending", "completed", "failed", "refunded"]
ADJUSTMENT_TYPES = ["purchase", "return", "damage", "manual", "audit"]
