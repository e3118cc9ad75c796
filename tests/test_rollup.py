"""Reports from the roll-up equal the scans after several micro-batches, voids and returns included."""

import os

import pytest

from tests.conftest import SF_SMALL
from tillroll.operators import reports as C
from tillroll.sources.catalog import Retail
from tillroll.streaming import rollup


@pytest.fixture(scope="module")
def rolled(spark, tmp_path_factory):
    t = Retail.from_testdata(spark, SF_SMALL)
    folder, root = (str(tmp_path_factory.mktemp(n)) for n in ("changes", "root"))
    sold, back = rollup.bill_changes(t)
    sold.repartition(3).write.mode("append").parquet(folder)
    back.coalesce(1).write.mode("append").parquet(folder)
    for i, f in enumerate(sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))):
        os.utime(f"{folder}/{f}", (1_000_000 + i, 1_000_000 + i))
    store = rollup.maintain(spark.readStream.schema(sold.schema).option("maxFilesPerTrigger", 1).parquet(folder), root)
    assert store.describe()["batch"] == 3
    return t, rollup.Reports(store)


def _rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name,args,by_name", [
    ("dashboard_today", ("2001-07-18 12:00:00",), {}), ("dashboard_week", ("2001-07-18 12:00:00",), {}),
    ("dashboard_month", ("2001-07-18 12:00:00",), {}), ("daily_summary", ("2000-08-03",), {}), ("daily_hourly", ("2000-08-03",), {}),
    ("daily_payment_mix", ("2000-08-03",), {}), ("weekly_by_day", (), {"week_start": "2000-07-31"}),
    ("weekly_totals", (), {"week_start": "2000-07-31"}), ("monthly_summary", (2000, 5), {}), ("monthly_by_week", (2000, 5), {})])
def test_reports_equal_the_scans(rolled, name, args, by_name):
    t, reports = rolled
    assert _rows(getattr(reports, name)(*args, **by_name)) == _rows(getattr(C, name)(t, *args, **by_name))
