"""One test per decided quirk of the source application."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tillroll.functions import ranges as R
from tillroll.operators import integrity, ledger, reports
from tillroll.plans.joins import first_per_key
from tillroll.sources import schema as S
from tillroll.sources.catalog import Retail

T = dt.datetime(2024, 3, 10, 0, 0)


def _bills(spark, rows):
    return spark.createDataFrame(rows, S.BILLS)


def _bill(i, status="completed", at=T, net="100.00", customer=2):
    n = D(net)
    return (i, f"B{i}", customer, 3, n, D("0"), D("0"), n, "cash", status, at)


def test_q1_monthly_department_revenue_is_all_time(spark):
    t = Retail.from_testdata(spark, SF_MID)
    a = {r["department"]: r["revenue"] for r in reports.monthly_by_department(t, 2000, 5).collect()}
    b = {r["department"]: r["revenue"] for r in reports.monthly_by_department(t, 1996, 1).collect()}
    assert a == b                                   # the month only changes the counts
    fixed = {r["department"]: r["revenue"] for r in reports.monthly_by_department_fixed(t, 2000, 5).collect()}
    assert sum(fixed.values()) < sum(a.values())


def test_q2_department_report_drops_departments_without_sales(spark):
    t = Retail.from_testdata(spark, SF_MID)
    quirk = reports.department_report(t, "2000-05-01", "2000-05-31").count()
    fixed = reports.department_report_fixed(t, "2000-05-01", "2000-05-31")
    assert fixed.count() == t.departments.count() > quirk
    assert fixed.filter("total_bills = 0").count() == fixed.count() - quirk


def test_q3_between_dates_ends_at_midnight(spark, seed):
    b = _bills(spark, [_bill(1, at=dt.datetime(2024, 3, 10, 0, 0)), _bill(2, at=dt.datetime(2024, 3, 10, 9, 30)),
                       _bill(3, at=dt.datetime(2024, 3, 9, 23, 0))])
    t = seed.with_tables(bills=b)
    got = {r["id"] for r in R.bills_in(t, R.between_dates("2024-03-09", "2024-03-10")).collect()}
    assert got == {1, 3}


def test_q6_net_sales_counts_partially_returned(spark, seed):
    b = _bills(spark, [_bill(1), _bill(2, status="partially_returned")])
    ret = spark.createDataFrame([(2, 2, 3, 3, 1, D("40.00"), T)], S.RETURNS)
    t = seed.with_tables(bills=b, returns=ret)
    r = reports.net_sales(t, "2024-03-10", "2024-03-11").first()
    assert (r["total_bills"], r["gross_revenue"], r["returned_amount"], r["net_sales"]) == \
        (2, D("200.00"), D("40.00"), D("160.00"))
    assert reports.tax_summary(t, "2024-03-10", "2024-03-11").first()["total_bills"] == 1


def test_q7_void_of_partially_returned_bill(spark, seed):
    b = _bills(spark, [_bill(1, status="partially_returned")])
    items = spark.createDataFrame([(1, 3, 4, D("130"), D("0"), D("5"), D("26"), D("546"))], S.BILL_ITEMS)
    ret = spark.createDataFrame([(1, 1, 3, 3, 1, D("136.50"), T)], S.RETURNS)
    t = seed.with_tables(bills=b, bill_items=items, returns=ret)
    req = spark.createDataFrame([(1,)], "bill_id bigint")
    assert ledger.void_bills(t, req)[1].first()["restored"] == 4           # reproduced: all units again
    assert ledger.void_bills_fixed(t, req).first()["restored"] == 3        # fixed: only unreturned units


def test_q9_bill_numbers_widen_past_four_digits(spark):
    b = spark.createDataFrame([(1, T), (2, T + dt.timedelta(seconds=1))], "id bigint, created_at timestamp_ntz")
    got = [r["bill_number"] for r in ledger.bill_numbers(b, start_seq=9999).orderBy("seq").collect()]
    assert got == ["BILL-20240310-9999", "BILL-20240310-10000"]


def test_q12_q20_returns(spark, seed):
    b = _bills(spark, [_bill(1)])
    items = spark.createDataFrame([(1, 3, 4, D("130"), D("0"), D("5"), D("26"), D("546"))], S.BILL_ITEMS)
    t = seed.with_tables(bills=b, bill_items=items)
    req = spark.createDataFrame(
        [(10, 1, 3, 2, T), (10, 1, 3, 3, T),                      # two lines of one product: 5 > 4 sold
         (11, 1, 3, 1, T + dt.timedelta(hours=1)),                # valid, first valid request for the bill
         (12, 1, 3, 1, T + dt.timedelta(hours=2))],               # valid alone, but the bill is already returned
        "request_id bigint, bill_id bigint, product_id bigint, quantity int, created_at timestamp_ntz")
    v = {r["request_id"]: r["reject_reason"] for r in ledger.validate_returns(t, req).collect()}
    assert v == {10: "quantity_exceeds_sold", 11: None, 12: "bill_already_returned"}


def test_q17_refund_amounts(spark, seed):
    pays = spark.createDataFrame([(5, 1, D("100.00"), "card", "completed", None, 3, T)], S.PAYMENTS)
    t = seed.with_tables(payments=pays)
    req = spark.createDataFrame([(1, 5, D("-10.00"), T), (2, 5, None, T), (3, 5, D("150.00"), T)],
                                "request_id bigint, payment_id bigint, amount decimal(12,2), created_at timestamp_ntz")
    rows, upd = ledger.refund_payments(t, req)
    assert {r["id"]: r["amount"] for r in rows.collect()} == {2: D("-100.00")}
    assert [r["id"] for r in upd.collect()] == [5]


def test_q18_payment_completes_voided_bill(spark, seed):
    t = seed.with_tables(bills=_bills(spark, [_bill(1, status="voided")]))
    req = spark.createDataFrame([(7, 1, D("100.00"), "upi", T)],
                                "request_id bigint, bill_id bigint, amount decimal(12,2), method string, "
                                "created_at timestamp_ntz")
    assert ledger.record_payments(t, req)[1].first()["status"] == "completed"
    assert ledger.record_payments(t, req, fixed=True)[1].count() == 0


def test_q21_patch_null_keeps_value(spark, seed):
    patch = spark.createDataFrame([(1, None, "new@example.com", 1), (1, "Amit S.", None, 2)],
                                  "id bigint, name string, email string, patch_seq long")
    out, rejects = integrity.apply_patch(seed.customers, patch, "id", ["name", "email"])
    r = out.filter("id = 1").first()
    assert (r["name"], r["email"], r["changed"]) == ("Amit S.", "new@example.com", True)
    assert rejects.count() == 0


def test_first_per_key_equals_window_with_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
                                   ((F.col("id") * 7919) % 20011).alias("o"), F.col("id").alias("v"))
    got = first_per_key(df, ["k"], ["o", "v"]).select("k", "o", "v")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "v"))) \
        .filter("rn = 1").select("k", "o", "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_unknown_report_falls_back_to_dashboard(spark):
    t = Retail.from_testdata(spark, SF_MID)
    assert reports.report(t, "no-such-report", as_of="2001-07-18 12:00:00").columns == \
        reports.dashboard(t, "2001-07-18 12:00:00").columns
