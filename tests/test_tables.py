"""The bucketed model tables: equal reports, no shuffle of lines by bill, only the window's months read."""

import pytest

from tests.conftest import SF_SMALL
from tillroll.operators import listing, reports
from tillroll.sources.catalog import Retail, save_tables


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    t = Retail.from_testdata(spark, SF_SMALL)
    save_tables(t, "tillroll_buckets", 4, str(tmp_path_factory.mktemp("buckets")))
    yield t, Retail.from_tables(spark, "tillroll_buckets")
    spark.sql("DROP DATABASE tillroll_buckets CASCADE")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reports_are_equal(both):
    t, b = both
    for report in (reports.department_report, reports.tax_by_rate, reports.top_products):
        assert _rows(report(t, "2000-05-01", "2000-05-31")) == _rows(report(b, "2000-05-01", "2000-05-31"))
    assert _rows(listing.document_summary(listing.bill_documents(t))) == _rows(listing.document_summary(listing.bill_documents(b)))


def test_lines_meet_bills_without_a_shuffle(spark, both):
    _, b = both
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = b.bill_items.join(b.bills, b.bill_items.bill_id == b.bills.id).groupBy("bill_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_a_window_reads_its_months(both):
    _, b = both
    plan = b.bills_window("2000-05-01", "2000-05-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]
