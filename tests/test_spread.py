"""Work is dealt to parts that grow in number with the rows, and large dimensions are not broadcast."""

import time

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll import registry_queries as Q
from tillroll.operators import ledger, listing
from tillroll.plans import spread
from tillroll.plans.admission import breakpoints, replay
from tillroll.plans.sequence import running_sum
from tillroll.sources import workloads
from tillroll.sources.catalog import Retail
from tillroll.streaming import intake, stock


def _rows(df):
    return sorted(map(str, df.collect()))


def test_rows_read_come_from_the_files(spark):
    t = Retail.from_testdata(spark, SF_SMALL)
    assert spread.rows_read(t.bill_items) == t.bill_items.count()
    assert spread.rows_read(t.returns) == t.bill_items.count() + t.bills.count()
    assert spread.rows_read(spark.createDataFrame([(1,)], "a int")) == 0


def test_returns_are_dealt_by_bill(spark, monkeypatch):
    t = Retail.from_testdata(spark, SF_SMALL)
    few = _rows(Q._validated_gaps(t))
    monkeypatch.setattr(spread, "PART_ROWS", 200)
    many = Q._validated_gaps(t)
    assert _rows(many) == few
    assert many.rdd.getNumPartitions() >= t.bill_items.count() // 200
    assert _rows(ledger.return_items(ledger.apply_returns(t, many)[0])) == _rows(
        many.filter("reject_reason is null").select(F.col("request_id").alias("id"), "bill_id", "product_id", "quantity"))


def test_running_sums_and_movements_are_dealt(spark, monkeypatch):
    t = Retail.from_testdata(spark, SF_SMALL)

    def made():
        gaps = ledger.explained_gaps(workloads.audited_ledger(ledger.stock_ledger(t), ledger.stock_movements(t)), ledger.stock_movements(t))
        sums = running_sum(t.stock_adjustments, "product_id", ["created_at", "id"], "adjustment", F.to_date("created_at"))
        return gaps, stock.stock_events(t), sums

    few = [_rows(df) for df in made()]
    monkeypatch.setattr(spread, "PART_ROWS", 100)
    many = made()
    assert [_rows(df) for df in many] == few
    assert "REPARTITION_BY_NUM" in many[2]._jdf.queryExecution().toString()


def test_bulk_search_in_parts_without_broadcasts(spark, monkeypatch):
    t = Retail.from_testdata(spark, SF_SMALL)
    whole = _rows(listing.bulk_product_search(t, listing.typed_terms(t)))
    monkeypatch.setattr(listing, "_GRAM_PRODUCTS", 60)
    cut = listing.bulk_product_search(t, listing.typed_terms(t))
    assert _rows(cut) == whole
    # a sku is looked up by a long substring, which few products hold
    assert max(listing._GRAMS) >= 8


def test_large_dimensions_are_shuffled(spark, monkeypatch):
    t = Retail.from_testdata(spark, SF_SMALL)
    assert spread.shuffled(t.products).join(t.bill_items, F.col("id") == F.col("product_id"))._jdf.queryExecution().toString().count("Broadcast")
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 10)
    plan = t.bill_items.join(spread.shuffled(t.products), F.col("id") == F.col("product_id"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_request_files_do_not_follow_the_shuffle_partitions(spark, tmp_path):
    t = Retail.from_testdata(spark, SF_SMALL)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        intake._request_files(spark, t, str(tmp_path / "a"))
        intake.write_requests_in_time_order(t, str(tmp_path / "b"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    for folder in "ab":
        assert 1 <= len(list((tmp_path / folder).glob("part-*"))) <= intake.LEAST_FILES
        assert spark.read.text(str(tmp_path / folder)).count() == intake.order_requests_json(t).count()


def test_request_text_is_not_kept_with_the_order(spark):
    raw = intake.parsed(spark.createDataFrame([("",), ("no json",), ('{"request_id": 4}',), (None,)], "value string"))
    assert "value" not in raw.columns
    orders, bad = intake.parse_orders(raw)
    assert [r["request_id"] for r in orders.collect()] == [4]
    assert [r["reject_reason"] for r in bad.collect()] == ["malformed_json"] * 3


def test_every_priced_order_is_kept(spark, tmp_path):
    """An order refused for a negative total is no bill, but its totals are among what the intake priced."""
    t = Retail.from_testdata(spark, SF_SMALL)
    body = '{"request_id": %d, "paymentMethod": "cash", "discountAmount": %d, "items": [{"productId": 1, "quantity": 1}]}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0.txt").write_text(body % (7, 1000000) + body % (8, 0))
    root = intake.run_intake(spark, t, str(tmp_path / "in"))
    assert [r["bill_id"] for r in intake.committed_rows(spark, root, "bills").collect()] == [8]
    assert sorted(r["bill_id"] for r in intake.priced_rows(spark, root).collect()) == [7, 8]


def test_breakpoints_of_a_long_history():
    """Ten thousand steps on one balance: each touches the pieces it changes, not all of them in turn."""
    deltas = [((i * 7919) % 101 - 45) * 3 for i in range(10_000)]
    start = time.process_time()
    starts, shifts = breakpoints(deltas)
    assert time.process_time() - start < 5
    for balance in (0, 7, 500, 10_000):
        shift = [s for b, s in zip(starts, shifts) if b <= balance][-1]
        assert balance + shift == replay(balance, deltas)[2]
