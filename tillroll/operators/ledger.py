"""Transaction arithmetic as set-based jobs.

The source application prices, bills, voids, returns and pays one request at
a time inside a database transaction.  Each function here takes a *table* of
requests and returns the rows the source would have written (or the updated
state), using joins and aggregates keyed by bill, product or customer.

Money stays decimal throughout: line tax is carried exactly (scale 6) and
rounded half-up once where it is stored (quirk Q8 fixed in the totals,
reported by ``tax_reconciliation``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.loyalty import CURRENCY_PER_POINT, POINT_VALUE, tier
from tillroll.plans.joins import first_per_key
from tillroll.plans.sequence import global_row_number, running_sum
from tillroll.plans.spread import parts_for, rows_read, spread
from tillroll.sources.schema import MONEY, RECORD_METHODS, TOTAL

EXACT = "decimal(24,6)"
def _cent() -> F.Column:
    return F.lit("0.01").cast("decimal(3,2)")


def _r2(c) -> F.Column:
    return F.round(c, 2).cast(TOTAL)


# ------------------------------------------------------------- D1–D3 pricing
def price_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Price order lines at the product's price and tax rate.

    ``lines``: (bill_id, product_id, quantity, discount).  net = price*qty - discount,
    tax = net*rate/100 (exact), total = net + tax; stored tax and total are
    rounded half-up to cents.  Unknown products drop out (inner join)."""
    p = products.select(F.col("id").alias("_pid"), F.col("price").alias("unit_price"), "tax_rate")
    j = lines.join(p, lines.product_id == p._pid, "inner").drop("_pid")
    disc = F.coalesce(F.col("discount"), F.lit(0).cast(MONEY))
    net = (F.col("unit_price") * F.col("quantity") - disc).cast(TOTAL)
    return (j.withColumn("discount", disc.cast(MONEY))
            .withColumn("net_price", net)
            .withColumn("tax_exact", (F.col("net_price") * F.col("tax_rate") * _cent()).cast(EXACT))
            .withColumn("tax_amount", _r2(F.col("tax_exact")))
            .withColumn("total_price", _r2(F.col("net_price") + F.col("tax_exact"))))


def bill_totals(priced: DataFrame, headers: DataFrame) -> DataFrame:
    """Per bill Σnet, Σtax (exact, one final round) and net = Σnet + Σtax − bill discount.

    ``headers``: (id, discount_amount).  Also reports Σ of the per-line
    rounded tax and its difference to the bill tax (Q8 reconciliation)."""
    per = priced.groupBy("bill_id").agg(
        F.sum("net_price").alias("_net"), F.sum("tax_exact").alias("_tax"),
        F.sum("tax_amount").cast(TOTAL).alias("line_tax_sum"))
    h = headers.select(F.col("id").alias("_hid"), F.coalesce("discount_amount", F.lit(0).cast(MONEY))
                       .alias("discount_amount"))
    j = per.join(h, per.bill_id == h._hid, "inner")
    return j.select(
        "bill_id", F.col("_net").cast(TOTAL).alias("total_amount"), _r2(F.col("_tax")).alias("tax_amount"),
        F.col("discount_amount").cast(TOTAL).alias("discount_amount"),
        _r2(F.col("_net") + F.col("_tax") - F.col("discount_amount")).alias("net_amount"),
        "line_tax_sum", (F.col("line_tax_sum") - _r2(F.col("_tax"))).cast(TOTAL).alias("tax_difference"))


def tax_reconciliation(totals: DataFrame) -> DataFrame:
    """Q8: bills whose per-line rounded tax differs from the bill's rounded tax."""
    return totals.filter(F.col("tax_difference") != 0).select("bill_id", "tax_amount", "line_tax_sum",
                                                               "tax_difference")


def bill_numbers(bills: DataFrame, start_seq: int = 1) -> DataFrame:
    """D3: ``BILL-yyyymmdd-NNNN`` from one global sequence in (created_at, id) order.

    The sequence is a distributed global row number (no single-partition
    window); the width grows past 4 digits instead of truncating (Q9)."""
    numbered = global_row_number(bills.select("id", "created_at"), ["created_at", "id"], out="seq")
    seq = (F.col("seq") + (start_seq - 1)).cast("bigint")
    s = seq.cast("string")
    return numbered.select(
        "id", "created_at", seq.alias("seq"),
        F.concat(F.lit("BILL-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-"),
                 F.lpad(s, F.greatest(F.lit(4), F.length(s)), "0")).alias("bill_number"))


# ------------------------------------------------------------- D5–D8 stock, loyalty, voids
def apply_sales(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Stock − Σ quantity sold, per product (lines pre-aggregated per product)."""
    sold = lines.groupBy(F.col("product_id").alias("_pid")).agg(F.sum("quantity").alias("sold"))
    j = products.join(sold, products.id == sold._pid, "left")
    return j.select(
        "id", F.col("stock_quantity").alias("previous_stock"), F.coalesce("sold", F.lit(0)).cast("bigint").alias("sold"),
        (F.col("stock_quantity") - F.coalesce("sold", F.lit(0))).cast("int").alias("stock_quantity"),
        F.col("sold").isNotNull().alias("changed"))


def accrue_loyalty(customers: DataFrame, bills: DataFrame) -> DataFrame:
    """D6 + D7: + floor(net/10) points per bill and + net to lifetime purchases;
    the tier is re-derived only for customers whose points changed (the
    trigger fires on UPDATE only, Q10)."""
    b = bills.filter(F.col("customer_id").isNotNull())
    per = b.groupBy(F.col("customer_id").alias("_cid")).agg(
        F.sum(F.floor(F.col("net_amount") / CURRENCY_PER_POINT).cast("bigint")).alias("points_added"),
        F.sum("net_amount").alias("spent"))
    j = customers.join(per, customers.id == per._cid, "left")
    changed = F.col("points_added").isNotNull()
    new_points = (F.col("loyalty_points") + F.coalesce("points_added", F.lit(0))).cast("int")
    return j.select(
        "id", F.coalesce("points_added", F.lit(0).cast("bigint")).alias("points_added"),
        new_points.alias("loyalty_points"),
        (F.col("total_purchases") + F.coalesce("spent", F.lit(0))).cast("decimal(14,2)").alias("total_purchases"),
        F.when(changed, tier(new_points)).otherwise(F.col("loyalty_tier")).alias("loyalty_tier"),
        changed.alias("changed"))


def stale_tiers(customers: DataFrame) -> DataFrame:
    """Q10: customers whose stored tier disagrees with their points."""
    return customers.filter(F.col("loyalty_tier") != tier("loyalty_points")).select(
        "id", "loyalty_points", "loyalty_tier", tier("loyalty_points").alias("expected_tier"))


def void_decisions(t, requests: DataFrame) -> DataFrame:
    """Each requested ``bill_id`` once, with its ``reject_reason`` (null: voided)."""
    b = t.bills.select(F.col("id").alias("_bid"), F.col("status").alias("_bstatus"))
    asked = requests.select("bill_id").distinct()
    return asked.join(b, asked.bill_id == b._bid, "left").select("bill_id", F.when(
        F.col("_bid").isNull(), "bill_not_found").when(F.col("_bstatus") == "voided", "bill_already_voided").alias("reject_reason"))


def void_bills(t, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Void the requested bills (``bill_id``); already voided ones are skipped.

    Returns (bill updates, product stock after, customer loyalty after).
    Stock gets back every line's quantity (Q7: even of partially returned
    bills); points drop by floor(net/10) per bill and lifetime by net, both
    clamped at 0 once after summing (max(0,max(0,x-a)-b) = max(0,x-a-b))."""
    req = requests.select(F.col("bill_id").alias("_rid")).distinct()
    b = t.bills.filter(F.col("status") != "voided")
    hit = b.join(req, b.id == req._rid, "left_semi")
    updates = hit.select("id", F.col("status").alias("previous_status"), F.lit("voided").alias("status"))
    items = t.bill_items
    lines = items.join(hit.select(F.col("id").alias("_bid")), items.bill_id == F.col("_bid"), "left_semi")
    back = lines.groupBy(F.col("product_id").alias("_pid")).agg(F.sum("quantity").alias("restored"))
    p = t.products.join(back, t.products.id == back._pid, "inner").select(
        "id", F.col("stock_quantity").alias("previous_stock"), F.col("restored").cast("bigint").alias("restored"),
        (F.col("stock_quantity") + F.col("restored")).cast("int").alias("stock_quantity"))
    per = hit.filter(F.col("customer_id").isNotNull()).groupBy(F.col("customer_id").alias("_cid")).agg(
        F.sum(F.floor(F.col("net_amount") / CURRENCY_PER_POINT).cast("bigint")).alias("points_removed"),
        F.sum("net_amount").alias("spent_removed"))
    c = t.customers.join(per, t.customers.id == per._cid, "inner").select(
        "id", "points_removed",
        F.greatest(F.lit(0), F.col("loyalty_points") - F.col("points_removed")).cast("int").alias("loyalty_points"),
        F.greatest(F.lit(0), F.col("total_purchases") - F.col("spent_removed")).cast("decimal(14,2)")
        .alias("total_purchases"))
    return updates, p, c


def void_bills_fixed(t, requests: DataFrame) -> DataFrame:
    """Q7 intent: voiding gives back only what was not already returned
    (sold − returned per bill and product, from the returns rows)."""
    req = requests.select(F.col("bill_id").alias("_rid")).distinct()
    hit = t.bills.filter(F.col("status") != "voided").join(req, F.col("id") == F.col("_rid"), "left_semi")
    ids = hit.select(F.col("id").alias("_bid"))
    sold = (t.bill_items.join(ids, F.col("bill_id") == F.col("_bid"), "left_semi")
            .groupBy("bill_id", "product_id").agg(F.sum("quantity").alias("_sold")))
    back = (t.returns.join(ids, F.col("bill_id") == F.col("_bid"), "left_semi")
            .groupBy(F.col("bill_id").alias("_rb"), F.col("product_id").alias("_rp"))
            .agg(F.sum("quantity").alias("_ret")))
    j = sold.join(back, (sold.bill_id == back._rb) & (sold.product_id == back._rp), "left")
    per = j.groupBy(F.col("product_id").alias("_pid")).agg(
        F.sum(F.greatest(F.lit(0), F.col("_sold") - F.coalesce("_ret", F.lit(0)))).alias("restored"))
    return t.products.join(per, t.products.id == per._pid, "inner").select(
        "id", F.col("stock_quantity").alias("previous_stock"), F.col("restored").cast("bigint").alias("restored"),
        (F.col("stock_quantity") + F.col("restored")).cast("int").alias("stock_quantity"))


# ------------------------------------------------------------- D9–D11 returns
def validate_returns(t, requests: DataFrame) -> DataFrame:
    """D9 + D10: check and price return requests.

    ``requests``: (request_id, bill_id, product_id, quantity, created_at).  Lines of one
    request for the same product are summed (Q12); a request is refused as a
    whole when a line has no quantity, its bill is not ``completed``, a product is not on the bill, a
    quantity is not positive or exceeds what was sold.  When a bill gets
    several requests, the first by (created_at, request_id) wins (Q20).
    Money: Σ total_price/quantity × returned, tax-inclusive, one final round.

    Everything is keyed by bill: requests, lines and bills meet in one partitioning by bill, whose parts
    grow in number with the lines, and the verdicts are windows over it.
    """
    parts = parts_for(requests, rows_read(t.bill_items))
    requests = spread(requests, parts, "bill_id")
    req = requests.groupBy("request_id", "bill_id", "product_id").agg(
        F.sum("quantity").alias("quantity"), F.min("created_at").alias("created_at"),
        F.min("quantity").alias("_min_q"), F.bool_or(F.col("quantity").isNull()).alias("_no_q"))
    # only the lines of bills that a request names are aggregated
    wanted = requests.select("bill_id").distinct()
    sold = spread(t.bill_items.select("bill_id", "product_id", "quantity", "total_price"), parts, "bill_id").join(
        wanted, "bill_id", "left_semi").groupBy(
        F.col("bill_id").alias("_sb"), F.col("product_id").alias("_sp")).agg(
        F.sum("quantity").alias("sold_quantity"), F.sum("total_price").alias("sold_total"))
    b = t.bills.select(F.col("id").alias("_bid"), F.col("status").alias("bill_status"))
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    j = dealt(req.join(b, req.bill_id == b._bid, "left"), "bill_id", "product_id")
    s = dealt(sold, "_sb", "_sp")
    j = dealt(j.join(s, (F.col("bill_id") == F.col("_sb")) & (F.col("product_id") == F.col("_sp")), "left"), "bill_id")
    reason = (F.when(F.col("_no_q"), "quantity_missing").when(F.col("_bid").isNull(), "bill_not_found")
              .when(F.col("bill_status") != "completed", "bill_not_returnable")
              .when(F.col("sold_quantity").isNull(), "product_not_on_bill")
              .when(F.col("_min_q") <= 0, "quantity_not_positive")
              .when(F.col("quantity") > F.col("sold_quantity"), "quantity_exceeds_sold"))
    # total/qty*returned at scale 6, half-up, in integer micro-units (exact, no
    # decimal division): (2*cents*q*10^4 + sold) div (2*sold).
    micro = F.expr("(cast(sold_total * 100 as bigint) * quantity * 20000 + sold_quantity) div (2 * sold_quantity)")
    amount = (micro.cast("decimal(24,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(24,6)")
    lines = j.select("request_id", "bill_id", "product_id", F.col("quantity").cast("int").alias("quantity"),
                     "created_at", reason.alias("line_reject"),
                     F.when(reason.isNull(), amount).alias("amount_exact"))
    # A request fails as a whole when any of its lines fails (first reason by name).
    one = Window.partitionBy("request_id", "bill_id")
    lines = lines.withColumn("_req_reject", F.min("line_reject").over(one)).withColumn("_at", F.min("created_at").over(one))
    # Among the valid requests of one bill the earliest wins: it moves the bill
    # out of ``completed``, so the later ones find it no longer returnable.
    winner = F.min(F.when(F.col("_req_reject").isNull(), F.struct("_at", "request_id"))).over(Window.partitionBy("bill_id"))
    out = lines.withColumn("_winner", winner).withColumn("reject_reason", F.coalesce(
        "_req_reject", F.when(F.col("request_id") != F.col("_winner.request_id"), F.lit("bill_already_returned"))))
    return out.select("request_id", "bill_id", "product_id", "quantity", "created_at", "reject_reason",
                      F.when(F.col("reject_reason").isNull(), F.col("amount_exact")).alias("amount_exact"))


def return_amounts(validated: DataFrame) -> DataFrame:
    """Accepted requests with their refund (Σ exact line amounts, one round)."""
    ok = validated.filter(F.col("reject_reason").isNull())
    return ok.groupBy("request_id", "bill_id").agg(
        _r2(F.sum("amount_exact")).alias("return_amount"), F.sum("quantity").cast("bigint").alias("items_returned"),
        F.min("created_at").alias("created_at"))


def apply_returns(t, validated: DataFrame, cashier_id=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(returns rows with JSON items, stock after, bill status updates).

    Loyalty is not reversed (as the source); the bill becomes
    ``partially_returned`` even when everything came back."""
    ok = validated.filter(F.col("reject_reason").isNull())
    amounts = return_amounts(validated)
    items_json = ok.groupBy("request_id").agg(F.to_json(F.sort_array(F.collect_list(
        F.struct(F.col("product_id").alias("productId"), F.col("quantity").alias("quantity"))))).alias("items"))
    rows = amounts.join(items_json, "request_id").select(
        F.col("request_id").alias("id"), "bill_id", F.lit(cashier_id).cast("int").alias("cashier_id"),
        "return_amount", "items", "created_at")
    back = ok.groupBy(F.col("product_id").alias("_pid")).agg(F.sum("quantity").alias("restored"))
    p = t.products.join(back, t.products.id == back._pid, "inner").select(
        "id", F.col("stock_quantity").alias("previous_stock"), F.col("restored").cast("bigint").alias("restored"),
        (F.col("stock_quantity") + F.col("restored")).cast("int").alias("stock_quantity"))
    status = amounts.select(F.col("bill_id").alias("id"), F.lit("partially_returned").alias("status")).distinct()
    return rows, p, status


def return_items(returns_rows: DataFrame) -> DataFrame:
    """A4 read side: the JSON items column back to (return id, product, quantity) rows."""
    schema = "array<struct<productId:bigint,quantity:int>>"
    return returns_rows.select("id", "bill_id", F.explode(F.from_json("items", schema)).alias("it")).select(
        "id", "bill_id", F.col("it.productId").alias("product_id"), F.col("it.quantity").alias("quantity"))


# ------------------------------------------------------------- D13 points
def redemption_value(points) -> F.Column:
    """D13 arithmetic: discount = points × 0.50."""
    p = F.col(points) if isinstance(points, str) else points
    return (p * F.lit(POINT_VALUE).cast("decimal(3,2)")).cast(MONEY)


# ------------------------------------------------------------- D14–D18a payments
def payment_decisions(t, requests: DataFrame, fixed: bool = False) -> DataFrame:
    """Every request with its ``reject_reason`` (null: recorded)."""
    b = t.bills.select(F.col("id").alias("_bid"), F.col("status").alias("_bstatus"))
    j = requests.join(b, requests.bill_id == b._bid, "left")
    reason = (F.when(F.col("amount").isNull(), "amount_missing")
              .when(~F.col("method").isin(*RECORD_METHODS) | F.col("method").isNull(), "invalid_method")
              .when(F.col("_bid").isNull(), "bill_not_found"))
    if fixed:
        reason = reason.when(~F.col("_bstatus").isin("pending", "completed"), "bill_not_payable")
    return j.withColumn("reject_reason", reason).drop("_bid", "_bstatus")


def record_payments(t, requests: DataFrame, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(payment rows, bill updates) for requests (request_id, bill_id, amount, method, created_at).

    Accepted when there is an amount, the method is one of cash/card/upi/wallet and the bill
    exists; the amount is not checked against the bill.  Any bill becomes
    completed with that method (Q18; ``fixed`` accepts pending/completed
    bills only).  Several requests for one bill: the latest sets the bill."""
    ok = payment_decisions(t, requests, fixed).filter(F.col("reject_reason").isNull())
    pays = ok.select(F.col("request_id").alias("id"), "bill_id", F.col("amount").cast(MONEY).alias("amount"),
                     "method", F.lit("completed").alias("status"), "created_at")
    upd = (first_per_key(ok.select("bill_id", "created_at", "request_id", "method"), ["bill_id"],
                         ["created_at", "request_id"], latest=True)
           .select(F.col("bill_id").alias("id"), F.lit("completed").alias("status"),
                   F.col("method").alias("payment_method")))
    return pays, upd


def match_payments(t, requests: DataFrame) -> DataFrame:
    """D15 + D16: a payment verification matches a *pending* bill when
    |amount − net| <= 0.01; the amount in minor units is round(amount*100).  A
    verification without an amount is refused."""
    b = t.bills.select(F.col("id").alias("_bid"), "status", "net_amount")
    j = requests.join(b, requests.bill_id == b._bid, "left")
    diff = F.abs(F.col("amount").cast("decimal(14,2)") - F.col("net_amount"))
    reason = (F.when(F.col("amount").isNull(), "amount_missing").when(F.col("_bid").isNull(), "bill_not_found")
              .when(F.col("status") != "pending", "bill_not_pending")
              .when(diff > F.lit("0.01").cast("decimal(3,2)"), "amount_mismatch"))
    return j.select("request_id", "bill_id", F.col("amount").cast(MONEY).alias("amount"), "net_amount",
                    F.round(F.col("amount").cast(MONEY) * 100).cast("bigint").alias("amount_minor"),
                    reason.alias("reject_reason"))


def gateway_rejects(t, confirmations: DataFrame) -> DataFrame:
    """The confirmations without a gateway id, or that name no bill, with ``reject_reason``."""
    b = t.bills.select(F.col("id").alias("_bid"))
    j = confirmations.join(b, confirmations.bill_id == b._bid, "left")
    reason = F.when(F.col("gateway_transaction_id").isNull(), "gateway_id_missing").when(F.col("_bid").isNull(), "bill_not_found")
    return j.withColumn("reject_reason", reason).drop("_bid").filter("reject_reason is not null")


def confirm_gateway_payments(t, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payment rows, bill updates) for gateway confirmations (bill_id, gateway_transaction_id, created_at).

    The payment copies the bill's own net amount, method razorpay, status
    completed; unknown bills and confirmations without a gateway id produce nothing (INSERT … SELECT)."""
    b = t.bills.select(F.col("id").alias("_bid"), "net_amount", "cashier_id")
    j = confirmations.filter("gateway_transaction_id is not null").join(b, confirmations.bill_id == b._bid, "inner")
    pays = j.select("bill_id", F.col("net_amount").alias("amount"), F.lit("razorpay").alias("method"),
                    F.lit("completed").alias("status"), "gateway_transaction_id", "created_at")
    upd = j.select(F.col("bill_id").alias("id"), F.lit("completed").alias("status"),
                   F.lit("razorpay").alias("payment_method")).distinct()
    return pays, upd


def refund_decisions(t, requests: DataFrame) -> DataFrame:
    """Every request of (request_id, payment_id, amount, created_at) with its payment and ``reject_reason``.

    The original must be ``completed``; a null amount means the full
    amount; a non-positive amount or one above the original is refused
    (Q17).  Of several requests that could each be granted for one payment, the
    first by (created_at, request_id) is; the payment is refunded by then."""
    p = t.payments.select(F.col("id").alias("_pid"), F.col("bill_id"), F.col("amount").alias("paid"),
                          "method", F.col("status").alias("_pstatus"), "gateway_transaction_id")
    j = requests.join(p, requests.payment_id == p._pid, "left")
    amt = F.coalesce(F.col("amount").cast(MONEY), F.col("paid"))
    reason = (F.when(F.col("_pid").isNull(), "payment_not_found")
              .when(F.col("_pstatus") != "completed", "payment_not_refundable")
              .when(amt <= 0, "amount_not_positive")
              .when(amt > F.col("paid"), "amount_exceeds_payment"))
    j = j.withColumn("_why", reason).withColumn("_amt", amt)
    first = (j.filter(F.col("_why").isNull()).groupBy(F.col("payment_id").alias("_fp"))
             .agg(F.min(F.struct("created_at", "request_id"))["request_id"].alias("_first")))
    j = j.join(first, j.payment_id == first._fp, "left")
    return j.withColumn("reject_reason", F.coalesce("_why", F.when(
        F.col("request_id") != F.col("_first"), F.lit("payment_already_refunded")))).drop("_why", "_fp", "_first")


def refund_payments(t, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refund rows, original payment updates) of the granted requests.

    The refund row carries −|amount| and the original becomes ``refunded`` even
    when the refund is partial."""
    j = refund_decisions(t, requests)
    ok = j.filter(F.col("reject_reason").isNull())
    rows = ok.select(F.col("request_id").alias("id"), "bill_id", (-F.abs(F.col("_amt"))).cast(MONEY).alias("amount"),
                     "method", F.lit("refunded").alias("status"), "gateway_transaction_id", "created_at")
    upd = ok.select(F.col("payment_id").alias("id"), F.lit("refunded").alias("status")).distinct()
    return rows, upd


def net_collections(payments: DataFrame) -> DataFrame:
    """Σ amount per bill and method over completed and refunded rows (refunds net off)."""
    p = payments.filter(F.col("status").isin("completed", "refunded"))
    return p.groupBy("bill_id", "method").agg(F.sum("amount").cast(TOTAL).alias("net_collected"),
                                              F.count(F.lit(1)).alias("payment_rows"))



# ------------------------------------------------------------- D12a ledger
def stock_ledger(t, opening: DataFrame | None = None) -> DataFrame:
    """The stock adjustment audit trail as a running balance per product.

    ``previous_quantity`` / ``new_quantity`` = opening stock + Σ adjustments
    before / up to this row in (created_at, id) order.  The running sum is
    split by day (``plans.sequence.running_sum``) so one busy product does
    not put its whole history into one task.  ``opening`` (id,
    stock_quantity) defaults to the current product stock."""
    a = t.stock_adjustments
    p = (opening if opening is not None else t.products).select(
        F.col("id").alias("_pid"), F.col("stock_quantity").alias("_open"))
    r = running_sum(a, "product_id", ["created_at", "id"], "adjustment", F.to_date("created_at"), out="_run")
    j = r.join(p, r.product_id == p._pid, "inner")
    return j.select("id", "product_id", "created_at", "adjustment", "type",
                    (F.col("_open") + F.col("_run") - F.col("adjustment")).cast("bigint").alias("previous_quantity"),
                    (F.col("_open") + F.col("_run")).cast("bigint").alias("new_quantity"))


def _with_prior(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the product's row before, in (created_at, id) order; null for its first.

    The row before is found within the product's day, and for a day's first row among the last
    rows of the product's earlier days, so a busy product's history is not sorted in one task."""
    x = rows.withColumn("_day", F.to_date("created_at"))
    w = Window.partitionBy("product_id", "_day").orderBy("created_at", "id")
    days = x.groupBy("product_id", "_day").agg(F.max_by(value, F.struct("created_at", "id")).alias("_last"))
    earlier = days.select(F.col("product_id").alias("_dp"), F.col("_day").alias("_dd"), F.lag("_last").over(
        Window.partitionBy("product_id").orderBy("_day")).alias("_before"))
    j = x.withColumn("_in_day", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    j = j.join(earlier, F.col("product_id").eqNullSafe(F.col("_dp")) & F.col("_day").eqNullSafe(F.col("_dd")), "left")
    prior = F.when(F.col("_n") > 1, F.col("_in_day")).otherwise(F.col("_before"))
    return j.select(*rows.columns, prior.alias(out))


def ledger_gaps(ledger: DataFrame) -> DataFrame:
    """D12a check of stored balances, one row per faulty audit row.

    ``sum_error`` = new − (previous + adjustment), which the row itself must satisfy.
    ``unaudited_movement`` = previous − the prior row's new quantity: stock moved without an
    audit row (sales, voids, returns)."""
    j = _with_prior(ledger, "new_quantity", "_prior")
    return j.select("id", "product_id", "created_at",
                    (F.col("new_quantity") - F.col("previous_quantity") - F.col("adjustment")).cast("bigint").alias("sum_error"),
                    F.coalesce(F.col("previous_quantity") - F.col("_prior"), F.lit(0)).cast("bigint").alias("unaudited_movement")
                    ).filter("sum_error is null or sum_error <> 0 or unaudited_movement <> 0")


def stock_movements(t) -> DataFrame:
    """(product_id, created_at, moved): what moves stock without an audit row.  Sales take, returns give back.

    A void puts back what its bill took; the model stores no time of it, so a voided bill moves nothing."""
    b = t.bills.filter(F.col("status") != "voided").select(F.col("id").alias("_bid"), "created_at")
    parts = parts_for(t.bill_items, rows_read(t.bill_items))
    lines = spread(t.bill_items.select("bill_id", "product_id", "quantity"), parts, "bill_id").join(b, F.col("bill_id") == F.col("_bid"))
    sold = spread(lines, parts, "product_id", "created_at").groupBy("product_id", "created_at").agg((-F.sum("quantity")).alias("moved"))
    back = t.returns.select("product_id", "created_at", F.col("quantity").alias("moved"))
    return sold.unionByName(back)


def explained_gaps(ledger: DataFrame, movements: DataFrame) -> DataFrame:
    """Every audit row whose previous quantity is not the row before's new quantity, with what explains it.

    ``explained`` = the movements of the product after the row before, up to and with this row's time;
    ``unexplained`` is the rest of the gap.  Both timelines are merged into one running sum per product, split by day
    (``plans.sequence``); an audit row's share is the difference of two sums."""
    audit = ledger.select("id", "product_id", "created_at", F.lit(0).cast("bigint").alias("_moved"),
                          F.struct("previous_quantity", "new_quantity").alias("_q"))
    moves = movements.select(F.lit(None).cast(ledger.schema["id"].dataType).alias("id"), "product_id", "created_at",
                             F.col("moved").cast("bigint").alias("_moved"), F.lit(None).cast(audit.schema["_q"].dataType).alias("_q"))
    # At one time, movements (no id) come before audit rows.
    both = running_sum(audit.unionByName(moves), "product_id", ["created_at", "id"], "_moved", F.to_date("created_at"), out="_sum")
    rows = both.filter("id is not null").select("id", "product_id", "created_at", F.col("_q.previous_quantity").alias("previous_quantity"),
                                                F.struct(F.col("_q.new_quantity").alias("new"), F.col("_sum").alias("sum")).alias("_state"))
    j = _with_prior(rows, "_state", "_prior").filter("_prior is not null")
    gap = F.col("previous_quantity") - F.col("_prior.new")
    explained = F.col("_state.sum") - F.col("_prior.sum")
    return j.select("id", "product_id", "created_at", gap.cast("bigint").alias("gap"), explained.cast("bigint").alias("explained"),
                    (gap - explained).cast("bigint").alias("unexplained")).filter("gap <> 0 or unexplained <> 0")


# ------------------------------------------------------------- D4, D12, D13 ordered accepts
def admit_orders(t, orders: DataFrame) -> DataFrame:
    """Admit ``orders`` (bill ids with created_at) against current stock in arrival
    order, all-or-nothing per bill; their lines come from ``bill_items``."""
    from tillroll.plans.admission import admit_bills
    o = orders.select(F.col("id").alias("bill_id"), "created_at")
    lines = t.bill_items.join(o, "bill_id").select("bill_id", "product_id", "quantity", "created_at")
    stock = t.products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("stock"))
    return admit_bills(lines, stock)


def adjust_stock(t, adjustments: DataFrame | None = None) -> DataFrame:
    """Apply stock adjustments per product in (created_at, id) order, refusing
    any that would take stock below zero; audit rows carry previous/new.

    An unknown product, a missing adjustment and a missing time are refused
    with a reason and null quantities."""
    from tillroll.plans.admission import clamped_accept
    a = t.stock_adjustments if adjustments is None else adjustments
    opening = t.products.select("id", F.col("stock_quantity").alias("balance"))
    r = clamped_accept(a, opening, "product_id", ["created_at", "id"], "adjustment")
    return r.select("id", "product_id", "adjustment", F.coalesce("type", F.lit("manual")).alias("type"),
                    "adjusted_by", "created_at", "accepted",
                    F.col("balance_before").alias("previous_quantity"),
                    F.col("balance_after").alias("new_quantity"),
                    F.when(~F.col("accepted"), F.coalesce(F.replace("refused", F.lit("key_not"), F.lit("product_not")),
                                                          F.lit("insufficient_stock"))).alias("reject_reason"))


def redeem_points(t, requests: DataFrame) -> DataFrame:
    """Redemption requests (request_id, customer_id, points, created_at) in order
    per customer: points must be positive and covered by the balance; the
    discount is points × 0.50 and the tier follows the new balance."""
    from tillroll.plans.admission import clamped_accept
    r = requests.withColumn("_delta", F.when(F.col("points") > 0, -F.col("points")))
    ok = r.filter(F.col("_delta").isNotNull())
    bad = r.filter(F.col("_delta").isNull())
    opening = t.customers.select("id", F.col("loyalty_points").alias("balance"))
    dec = clamped_accept(ok, opening, "customer_id", ["created_at", "request_id"], "_delta")
    out = dec.select("request_id", "customer_id", "points", "created_at", "accepted", "balance_before",
                     F.when(F.col("accepted"), redemption_value("points")).alias("discount"),
                     F.when(F.col("accepted"), tier(F.col("balance_after"))).alias("loyalty_tier"),
                     F.col("balance_after").alias("loyalty_points"),
                     F.when(~F.col("accepted"), F.coalesce(F.replace("refused", F.lit("key_not"), F.lit("customer_not")),
                                                           F.lit("insufficient_points"))).alias("reject_reason"))
    refused = bad.select("request_id", "customer_id", "points", "created_at", F.lit(False).alias("accepted"),
                         F.lit(None).cast("bigint").alias("balance_before"), F.lit(None).cast(MONEY).alias("discount"),
                         F.lit(None).cast("string").alias("loyalty_tier"),
                         F.lit(None).cast("bigint").alias("loyalty_points"),
                         F.lit("points_not_positive").alias("reject_reason"))
    return out.unionByName(refused)
