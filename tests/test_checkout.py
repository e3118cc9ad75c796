"""S5 full checkout: state carried across micro-batches equals the batch ledger."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.sources.catalog import Retail
from tillroll.streaming import intake
from tillroll.streaming.store import Store


def test_checkout_carries_stock_loyalty_and_sequence(spark):
    t = Retail.from_testdata(spark, SF_SMALL)
    root = intake.run_checkout(spark, t, max_files=3)
    store = Store(spark, root)
    assert store.describe()["batch"] >= 1                         # several micro-batches ran
    bills, items, rejects = (store.read(n) for n in ("bills", "bill_items", "rejects"))
    n_req = intake.order_requests_json(t).count()                  # the broken bodies included
    assert bills.count() + rejects.count() == n_req                # every request is billed or refused
    assert bills.select("id").distinct().count() == bills.count()
    # bill numbers: one gap-free sequence across batches
    seqs = sorted(int(r["bill_number"].rsplit("-", 1)[1]) for r in bills.select("bill_number").collect())
    assert seqs == list(range(1, len(seqs) + 1))
    # stock after the last batch = opening stock - units of all admitted lines, never negative
    final = store.read("products")
    sold = items.groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    chk = t.products.select("id", F.col("stock_quantity").alias("opening")).join(
        final.select("id", "stock_quantity"), "id").join(sold, F.col("id") == F.col("product_id"), "left")
    assert chk.filter(F.col("stock_quantity") != F.col("opening") - F.coalesce("sold", F.lit(0))).count() == 0
    assert final.filter("stock_quantity < 0").count() == 0
    # loyalty after the last batch = opening + floor(net/10) per admitted bill
    cust = store.read("customers")
    pts = bills.filter("customer_id is not null").groupBy("customer_id").agg(
        F.sum(F.floor(F.col("net_amount") / 10)).cast("int").alias("pts"))
    chk = t.customers.select("id", F.col("loyalty_points").alias("opening")).join(
        cust.select("id", "loyalty_points"), "id").join(pts, F.col("id") == F.col("customer_id"), "left")
    assert chk.filter(F.col("loyalty_points") != F.col("opening") + F.coalesce("pts", F.lit(0))).count() == 0
    reasons = {r["reject_reason"] for r in rejects.select("reject_reason").distinct().collect()}
    assert {"malformed_json", "insufficient_stock"} <= reasons


def test_checkout_drops_requests_seen_in_earlier_batches(spark):
    import time as _time

    from tillroll.streaming.sinks import scratch
    t = Retail.from_testdata(spark, SF_SMALL)
    req_dir = scratch(spark, "test-dup-requests")
    reqs = intake.order_requests_json(t)
    reqs.coalesce(1).write.mode("append").text(req_dir)
    _time.sleep(1.1)
    reqs.coalesce(1).write.mode("append").text(req_dir)          # the same requests again, in a later file
    root = intake.run_checkout(spark, t, requests_dir=req_dir, max_files=1)
    store = Store(spark, root)
    assert store.describe()["batch"] == 1                            # two batches
    bills, first = store.read("bills"), store.read("bills", 1)
    assert bills.count() == first.count()                            # nothing billed twice
    assert bills.select("id").distinct().count() == bills.count()


def test_requests_without_a_time_and_no_requests_at_all(spark):
    t = Retail.from_testdata(spark, SF_SMALL)
    untimed = t.with_tables(bills=t.bills.withColumn("created_at", F.when(F.col("id") % 3 != 0, F.col("created_at"))))
    root = intake.run_checkout(spark, untimed, max_files=8)
    store = Store(spark, root)
    rejects = store.read("rejects")
    assert store.read("bills").count() + rejects.count() == intake.order_requests_json(untimed).count()
    assert rejects.filter("reject_reason = 'created_at_missing'").count() > 0
    nothing = intake.run_checkout(spark, t.with_tables(bills=t.bills.limit(0)))
    assert Store(spark, nothing).describe()["meta"]["next_seq"] == 1


def test_restart_goes_on_from_the_store(spark, tmp_path):
    """Files that arrive after a run, taken up under its root, give what one run over all of them gives."""
    import os
    import shutil
    t = Retail.from_testdata(spark, SF_SMALL)
    whole_dir, part = str(tmp_path / "all"), str(tmp_path / "part")
    intake.write_requests_in_time_order(t, whole_dir, 2)
    files = sorted(f for f in os.listdir(whole_dir) if f.startswith("part-"))
    whole = Store(spark, intake.run_checkout(spark, t, whole_dir, 1))
    os.makedirs(part)
    root = str(tmp_path / "root")
    for step in (files[:1], files[1:]):
        for f in step:
            shutil.copy2(f"{whole_dir}/{f}", part)
        intake.run_checkout(spark, t, part, 1, root)
    again = Store(spark, root)
    for table, cols in (("bills", ["id", "bill_number"]), ("products", ["id", "stock_quantity"]), ("customers", ["id", "loyalty_points"])):
        assert sorted(map(tuple, again.read(table).select(cols).collect())) == sorted(map(tuple, whole.read(table).select(cols).collect()))


def test_intake_refuses_negative_totals(spark):
    t = Retail.from_testdata(spark, SF_SMALL)
    line = '{"request_id": 7, "paymentMethod": "cash", "discountAmount": 1000000, "items": [{"productId": 1, "quantity": 1}]}'
    orders, _ = intake.parse_orders(intake.parsed(spark.createDataFrame([(line,)], "value string")))
    out = intake.process_orders(orders, t.products)
    assert out["bills"].count() == out["bill_items"].count() == 0
    assert [tuple(r) for r in out["rejects"].collect()] == [(7, "negative_total")]
