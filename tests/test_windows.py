"""Kept windows stay exact when files arrive out of order, are replayed or are taken up after a stop."""

from tests.conftest import SF_SMALL
from tillroll.sources.catalog import Retail
from tillroll.streaming import live, windows
from pyspark.sql import functions as F


def test_late_rows_repair_their_windows(spark, tmp_path):
    t = Retail.from_testdata(spark, SF_SMALL)
    bills = live.shuffled_bills_stream(t, str(tmp_path / "bills"), files=6, max_files=2)
    store = windows.maintain(bills, str(tmp_path / "root"), "DAY")
    done = t.bills.filter("status = 'completed'")
    want = {r[0]: (r[1], r[2]) for r in done.groupBy(F.date_trunc("DAY", "created_at").cast("timestamp_ntz")).agg(
        F.count("*"), F.sum("net_amount")).collect()}
    assert {r["window_start"]: (r["transactions"], r["revenue"]) for r in store.read("windows").collect()} == want
    late = store.read("late")
    assert late.count() > 0 and late.filter("created_at >= seen_until").count() == 0
    assert store.describe()["batch"] >= 2
    # taken up again with nothing new: the same version stays
    before = store.latest()
    windows.maintain(bills, str(tmp_path / "root"), "DAY")
    assert store.latest() == before
