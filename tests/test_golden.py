"""Golden values on the seed rows (hand-computed, SURVEY §5.2)."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tillroll.operators import ledger, listing, reports
from tillroll.sources import schema as S


def _bill(spark, seed):
    lines = spark.createDataFrame([(100, 3, 2, D("10.00")), (100, 7, 1, D("0.00"))],
                                  "bill_id bigint, product_id bigint, quantity int, discount decimal(12,2)")
    priced = ledger.price_lines(lines, seed.products)
    headers = spark.createDataFrame([(100, D("31.32"))], "id bigint, discount_amount decimal(12,2)")
    return priced, ledger.bill_totals(priced, headers)


def test_department_stats(seed):
    rows = {r["name"]: r for r in listing.department_stats(seed).collect()}
    assert rows["Groceries"]["product_count"] == 5 and rows["Groceries"]["inventory_value"] == D("70550.00")
    assert rows["Electronics"]["product_count"] == 3 and rows["Electronics"]["inventory_value"] == D("70405.00")
    assert rows["Clothing"]["product_count"] == 0 and rows["Clothing"]["inventory_value"] == 0


def test_low_stock_none(seed):
    assert listing.low_stock(seed).count() == 0
    assert reports.low_stock_count(seed).first()["low_stock_alerts"] == 0


def test_search_oil(seed):
    assert [r["name"] for r in listing.product_search(seed, "oil").collect()] == ["Sunflower Oil 1L"]
    assert [r["name"] for r in listing.product_search(seed, "8901234567901").collect()] == ["Bluetooth Earphones"]


def test_price_lines_and_totals(spark, seed):
    priced, totals = _bill(spark, seed)
    p = {r["product_id"]: r for r in priced.collect()}
    assert (p[3]["net_price"], p[3]["tax_amount"], p[3]["total_price"]) == (D("250.00"), D("12.50"), D("262.50"))
    assert (p[7]["net_price"], p[7]["tax_amount"], p[7]["total_price"]) == (D("1499.00"), D("269.82"), D("1768.82"))
    t = totals.first()
    assert (t["total_amount"], t["tax_amount"], t["net_amount"]) == (D("1749.00"), D("282.32"), D("2000.00"))


def test_loyalty_accrual_and_tier(spark, seed):
    bills = spark.createDataFrame([(100, 2, D("2000.00"))], "id bigint, customer_id bigint, net_amount decimal(12,2)")
    c = {r["id"]: r for r in ledger.accrue_loyalty(seed.customers, bills).collect()}
    assert c[2]["points_added"] == 200 and c[2]["loyalty_points"] == 1050 and c[2]["loyalty_tier"] == "silver"
    assert c[3]["loyalty_tier"] == "gold" and not c[3]["changed"]   # untouched row keeps its stale tier


def _with_bill(spark, seed):
    priced, totals = _bill(spark, seed)
    t = totals.first()
    bills = spark.createDataFrame([(100, "BILL-20240101-0001", 2, 3, t["total_amount"], D("31.32"), t["tax_amount"],
                                    t["net_amount"], "cash", "completed", seed_time())], S.BILLS)
    items = priced.select("bill_id", "product_id", "quantity", "unit_price", "discount", "tax_rate", "tax_amount",
                          "total_price").select(*[F.col(f.name).cast(f.dataType) for f in S.BILL_ITEMS.fields])
    return seed.with_tables(bills=bills, bill_items=items)


def seed_time():
    import datetime as dt
    return dt.datetime(2024, 1, 1, 10, 0)


def test_return_amount(spark, seed):
    t = _with_bill(spark, seed)
    req = spark.createDataFrame([(1, 100, 3, 1, seed_time())],
                                "request_id bigint, bill_id bigint, product_id bigint, quantity int, created_at timestamp_ntz")
    amt = ledger.return_amounts(ledger.validate_returns(t, req)).first()
    assert amt["return_amount"] == D("131.25")


def test_void_restores(spark, seed):
    t = _with_bill(spark, seed)
    req = spark.createDataFrame([(100,)], "bill_id bigint")
    upd, stock, cust = ledger.void_bills(t, req)
    s = {r["id"]: r["restored"] for r in stock.collect()}
    assert s == {3: 2, 7: 1}
    c = cust.first()
    assert c["id"] == 2 and c["points_removed"] == 200
    assert upd.first()["status"] == "voided"


def test_redeem_and_loyalty_views(spark, seed):
    assert spark.range(1).select(ledger.redemption_value(F.lit(100)).alias("v")).first()["v"] == D("50.00")
    assert [r["id"] for r in ledger.stale_tiers(seed.customers).collect()] == [3]
    nxt = {r["id"]: r["points_to_next_tier"] for r in listing.customer_loyalty(seed).collect()}
    assert nxt == {1: 2500, 2: 150, 3: -2000}
