"""Consistency properties between reports and of the distributed helpers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tillroll.operators import ledger, reports
from tillroll.plans.sequence import global_row_number, running_sum
from tillroll.sources.catalog import Retail


def test_report_sums_agree(spark):
    t = Retail.from_testdata(spark, SF_MID)
    week = reports.weekly_by_day(t, "2000-07-31").agg(F.sum("total_transactions"), F.sum("total_revenue")).first()
    tot = reports.weekly_totals(t, "2000-07-31").first()
    assert (week[0], week[1]) == (tot["total_transactions"], tot["total_revenue"])
    hours = reports.daily_hourly(t, "2000-08-03").agg(F.sum("transactions"), F.sum("revenue")).first()
    day = reports.daily_summary(t, "2000-08-03").first()
    assert (hours[0], hours[1]) == (day["total_transactions"], day["total_revenue"])
    weeks = reports.monthly_by_week(t, 2000, 5).agg(F.sum("transactions"), F.sum("revenue")).first()
    month = reports.monthly_summary(t, 2000, 5).first()
    assert (weeks[0], weeks[1]) == (month["total_transactions"], month["total_revenue"])


def test_dashboard_equals_parts(spark):
    t = Retail.from_testdata(spark, SF_MID)
    d = reports.dashboard(t, "2000-08-03 12:00:00").first()
    assert d["today_transactions"] == reports.dashboard_today(t, "2000-08-03 12:00:00").first()["total_transactions"]
    assert d["week_revenue"] == reports.dashboard_week(t, "2000-08-03 12:00:00").first()["total_revenue"]
    assert d["month_transactions"] == reports.dashboard_month(t, "2000-08-03 12:00:00").first()["total_transactions"]


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    got = global_row_number(df, ["k", "id"], partitions=7)
    want = df.withColumn("seq", F.row_number().over(Window.orderBy("k", "id")))
    assert got.select("k", "id", "seq").exceptAll(want).count() == 0
    assert got.count() == 5000


def test_running_sum_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("key"), F.col("id").alias("o"),
                                     (F.col("id") % 11 - 5).alias("v"))
    got = running_sum(df, "key", ["o"], "v", F.floor(F.col("o") / 97))
    w = Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("running", F.sum("v").over(w))
    assert got.select("key", "o", "v", "running").exceptAll(want).count() == 0


def test_bill_numbers_unique_and_ordered(spark):
    t = Retail.from_testdata(spark, SF_MID)
    n = ledger.bill_numbers(t.bills)
    assert n.select("bill_number").distinct().count() == t.bills.count()
    assert n.agg(F.min("seq"), F.max("seq")).first() == (1, t.bills.count())
