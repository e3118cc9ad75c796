"""Request streams derived from the test tables.

The source application receives one request at a time (a scanned code, a
customer key, an order); the set-based operators here take a table of them.
These derivations turn the driver's ``events`` and ``orders`` tables into
such request tables, so every lookup and write job reads whole tables and
grows with them.  Each rule has a twin SQL text in ``registry_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scans(events: DataFrame) -> DataFrame:
    """One scanned code per event: barcode (view), sku (click), unknown (error), else the id."""
    k = F.col("event_id")
    et = F.col("event_type")
    code = (F.when(et == "view", F.concat(F.lit("890"), F.lpad(k.cast("string"), 10, "0")))
            .when(et == "click", F.concat(F.lit("SKU"), k.cast("string")))
            .when(et == "error", F.concat(F.lit("X"), k.cast("string")))
            .otherwise(k.cast("string")))
    return events.select(k.alias("scan_id"), code.alias("code"))


def customer_keys(events: DataFrame) -> DataFrame:
    """One customer key per event: phone (view), email (click), unknown (error), else the id."""
    u = F.col("user_id")
    et = F.col("event_type")
    code = (F.when(et == "view", F.concat(F.lit("+91-"), F.lpad(u.cast("string"), 10, "0")))
            .when(et == "click", F.concat(F.lit("c"), u.cast("string"), F.lit("@mail.example")))
            .when(et == "error", F.lit("nobody@mail.example"))
            .otherwise(u.cast("string")))
    return events.select(F.col("event_id").alias("key_id"), code.alias("code"))


def payment_keys(orders: DataFrame) -> DataFrame:
    """One key per order: the gateway id form for even keys, the payment id otherwise."""
    k = F.col("o_orderkey")
    code = F.when(k % 2 == 0, F.concat(F.lit("pay_"), k.cast("string"))).otherwise(k.cast("string"))
    return orders.select(k.alias("key_id"), code.alias("code"))


def bill_keys(bills: DataFrame) -> DataFrame:
    """One key per bill: its bill number for even ids, its id otherwise."""
    k = F.col("id")
    code = F.when(k % 2 == 0, F.col("bill_number")).otherwise(k.cast("string"))
    return bills.select(k.alias("key_id"), code.alias("code"))


def order_lines(items: DataFrame) -> DataFrame:
    """Order lines to (re)price: every bill line as (bill_id, product_id, quantity, discount)."""
    return items.select("bill_id", "product_id", "quantity", "discount")


def void_requests(bills: DataFrame) -> DataFrame:
    """Void requests: every refunded bill, plus the voided ones (which must be skipped)."""
    return bills.filter(F.col("status").isin("refunded", "voided")).select(F.col("id").alias("bill_id"))


def with_unknown_bills(requests: DataFrame, every: int = 10) -> DataFrame:
    """The requests, and a tenth of them again for bills that do not exist (negative ids)."""
    again = requests.filter(F.col("bill_id") % every == 0).withColumn("bill_id", -F.col("bill_id"))
    if "request_id" in requests.columns:
        again = again.withColumn("request_id", -F.col("request_id"))
    return requests.unionByName(again)


def with_gaps(requests: DataFrame, column: str, key: str = "bill_id", every: int = 5) -> DataFrame:
    """The requests, those with a key divisible by ``every`` without a value in ``column``."""
    return requests.withColumn(column, F.when(F.col(key) % every != 0, F.col(column)))


def stored_ledger(ledger: DataFrame) -> DataFrame:
    """A stock ledger as stored rows, some with faults: every 31st row starts one unit too
    high, every 37th row has both balances two units too high."""
    one, two = F.when(F.col("id") % 31 == 0, 1).otherwise(0), F.when(F.col("id") % 37 == 0, 2).otherwise(0)
    return ledger.withColumn("previous_quantity", F.col("previous_quantity") + one + two) \
                 .withColumn("new_quantity", F.col("new_quantity") + two)


def audited_ledger(ledger: DataFrame, movements: DataFrame) -> DataFrame:
    """A ledger whose balances also hold the sales and returns up to each row, and the faults of ``stored_ledger``."""
    from tillroll.plans.sequence import running_sum
    moves = movements.select(F.lit(None).cast("bigint").alias("id"), "product_id", "created_at", F.col("moved").cast("bigint").alias("_moved"))
    both = running_sum(ledger.select(F.col("id").cast("bigint").alias("id"), "product_id", "created_at", F.lit(0).cast("bigint").alias("_moved")).unionByName(moves),
                       "product_id", ["created_at", "id"], "_moved", F.to_date("created_at"), out="_sum").filter("id is not null")
    rows = ledger.join(both.select(F.col("id").alias("_sid"), "_sum"), F.col("id") == F.col("_sid")).drop("_sid")
    moved = rows.withColumn("previous_quantity", F.col("previous_quantity") + F.col("_sum")).withColumn(
        "new_quantity", F.col("new_quantity") + F.col("_sum")).drop("_sum")
    return stored_ledger(moved)


def return_requests(lineitem: DataFrame) -> DataFrame:
    """Return requests: each line flagged 'R' asks to return half its units (rounded up);
    the seventh line of an order asks for one more unit than was sold."""
    q = F.col("l_quantity").cast("int")
    qty = F.when(F.col("l_linenumber") == 7, q + 1).otherwise(F.ceil(F.col("l_quantity") / 2).cast("int"))
    return lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_orderkey").alias("bill_id"),
        F.col("l_partkey").alias("product_id"), qty.alias("quantity"), F.col("l_shipdate").alias("created_at"))


def payment_requests(bills: DataFrame) -> DataFrame:
    """Payment records for pending and voided bills, with the bill's own method, an hour later."""
    b = bills.filter(F.col("status").isin("pending", "voided"))
    return b.select(F.col("id").alias("request_id"), F.col("id").alias("bill_id"), F.col("net_amount").alias("amount"),
                    F.col("payment_method").alias("method"),
                    F.timestamp_add("HOUR", F.lit(1), F.col("created_at")).alias("created_at"))


def payment_verifications(bills: DataFrame) -> DataFrame:
    """Verifications of every bill: the amount is off by 0, 1 or 2 cents (id mod 3)."""
    off = (F.col("id") % 3).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)")
    return bills.select(F.col("id").alias("request_id"), F.col("id").alias("bill_id"),
                        (F.col("net_amount") + off).cast("decimal(12,2)").alias("amount"))


def gateway_confirmations(bills: DataFrame) -> DataFrame:
    """Gateway confirmations for pending bills paid through the gateway."""
    b = bills.filter((F.col("status") == "pending") & (F.col("payment_method") == "razorpay"))
    return b.select(F.col("id").alias("bill_id"),
                    F.concat(F.lit("pay_"), F.col("id").cast("string")).alias("gateway_transaction_id"),
                    F.timestamp_add("HOUR", F.lit(1), F.col("created_at")).alias("created_at"))


def refund_requests(returns: DataFrame) -> DataFrame:
    """A refund of each partially returned bill's payment for the returned amount."""
    return returns.groupBy("bill_id").agg(F.sum("return_amount").cast("decimal(12,2)").alias("amount"),
                                          F.min("created_at").alias("created_at")).select(
        F.col("bill_id").alias("request_id"), F.col("bill_id").alias("payment_id"), "amount", "created_at")


def asked_twice(requests: DataFrame) -> DataFrame:
    """Every refund request, and the same again an hour later under another id."""
    again = requests.withColumns({"request_id": F.col("request_id") + 1_000_000_000,
                                  "created_at": F.timestamp_add("HOUR", F.lit(1), F.col("created_at"))})
    return requests.unionByName(again)


def customer_patches(events: DataFrame) -> DataFrame:
    """Signup events change a customer's e-mail (customer = user id), in event order."""
    e = events.filter(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("name"),
                    F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@mail.example")).alias("email"),
                    F.col("event_id").alias("patch_seq"))


def product_deactivations(events: DataFrame) -> DataFrame:
    """Error events retire the product with the event's id."""
    return events.filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"))


def new_products(events: DataFrame) -> DataFrame:
    """Purchase events propose a new product: sku from id/4 (collides), barcode for even ids."""
    k = F.col("event_id")
    e = events.filter(F.col("event_type") == "purchase")
    return e.select(k.alias("request_id"), F.concat(F.lit("New "), k.cast("string")).alias("name"),
                    F.concat(F.lit("SKU"), F.floor(k / 4).cast("string")).alias("sku"),
                    F.when(k % 2 == 0, F.concat(F.lit("890"), F.lpad(k.cast("string"), 10, "0"))).alias("barcode"),
                    F.floor(F.col("value")).cast("decimal(12,2)").alias("price"))


def new_customers(events: DataFrame) -> DataFrame:
    """Signup events propose a customer row keyed by the event id."""
    k = F.col("event_id")
    e = events.filter(F.col("event_type") == "signup")
    return e.select(k.alias("id"), F.concat(F.lit("Customer#"), k.cast("string")).alias("name"),
                    F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example")).alias("email"),
                    F.concat(F.lit("+91-"), F.lpad(k.cast("string"), 10, "0")).alias("phone"),
                    F.lit(0).alias("loyalty_points"), F.lit("bronze").alias("loyalty_tier"),
                    F.lit(0).cast("decimal(14,2)").alias("total_purchases"), F.lit(True).alias("is_active"))


def points_without_tiers(customers: DataFrame) -> DataFrame:
    """Customers of whom every third got 1,500 points by a bulk load that left the tiers alone."""
    return customers.withColumn("loyalty_points", F.when(F.col("id") % 3 == 0, F.col("loyalty_points") + 1500).otherwise(F.col("loyalty_points")))


def with_copies(customers: DataFrame, every: int = 40) -> DataFrame:
    """Customers, and every fortieth again under another id, with its phone and its e-mail in lower case."""
    again = customers.filter(F.col("id") % every == 0).withColumns({"id": -F.col("id") - 1, "email": F.lower("email")})
    return customers.unionByName(again)


def new_departments(departments: DataFrame, events: DataFrame) -> DataFrame:
    """Every department proposed again, and a department per signup event: fifty names, some blank."""
    k = F.col("event_id")
    name = F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Department "), (k % 50).cast("string")))
    return departments.select((-F.col("id") - 1).cast("bigint").alias("request_id"), "name").unionByName(
        events.filter(F.col("event_type") == "signup").select(k.cast("bigint").alias("request_id"), name.alias("name")))


def new_users(events: DataFrame) -> DataFrame:
    """Error events propose a user: three hundred e-mails in changing case (many held), a valid, unknown or no role."""
    k = F.col("event_id")
    email = F.concat(F.lit("user"), (k % 300).cast("string"), F.lit("@store.example"))
    role = F.when(k % 4 == 0, "cashier").when(k % 4 == 1, "manager").when(k % 4 == 2, "boss")
    return events.filter(F.col("event_type") == "error").select(
        k.cast("bigint").alias("request_id"), F.when(k % 13 != 0, F.concat(F.lit("User "), k.cast("string"))).alias("name"),
        F.when(k % 17 != 0, F.when(k % 2 == 1, F.upper(email)).otherwise(email)).alias("email"), role.alias("role"))


def department_patches(events: DataFrame) -> DataFrame:
    """Signup events describe a department anew (ids up to 29, so some are unknown); every third says nothing."""
    k = F.col("event_id")
    return events.filter(F.col("event_type") == "signup").select(
        (k % 30).alias("id"), F.when(k % 3 != 0, F.concat(F.lit("About "), k.cast("string"))).alias("description"), k.alias("patch_seq"))


def product_patches(events: DataFrame) -> DataFrame:
    """View events set a product's price or its least stock (product = event id modulo 500)."""
    k = F.col("event_id")
    return events.filter(F.col("event_type") == "view").select(
        (k % 500).alias("id"), F.when(k % 2 == 0, F.floor("value").cast("decimal(12,2)")).alias("price"),
        F.when(k % 3 == 0, (k % 40).cast("int")).alias("minimum_stock"), k.alias("patch_seq"))


def user_patches(events: DataFrame) -> DataFrame:
    """Click events give a user a role."""
    k = F.col("event_id")
    return events.filter(F.col("event_type") == "click").select(
        (k % 100).cast("int").alias("id"), F.when(k % 5 == 0, "manager").when(k % 5 == 1, "admin").alias("role"), k.alias("patch_seq"))


def redemption_requests(events: DataFrame) -> DataFrame:
    """Purchase events ask to redeem points: customer = user id, points = 100 × floor(value) (0 is refused)."""
    e = events.filter(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("customer_id"),
                    (F.floor("value") * 100).cast("int").alias("points"), F.col("ts").alias("created_at"))
