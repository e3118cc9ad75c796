"""Pages by cursor equal pages by offset, through ties and nulls."""

import pytest
from pyspark.sql import functions as F

from tillroll.plans.paging import after, cursor_of, page


@pytest.mark.parametrize("descending", [False, True])
def test_cursor_pages_equal_offset_pages(spark, descending):
    rows = [(i, None if i % 7 == 0 else f"n{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(3)
    order = [F.col("name").desc_nulls_last() if descending else F.col("name").asc_nulls_last()]
    cursor = None
    for n in range(1, 6):
        got = page(after(df, "name", cursor, descending), order, 1, 13)
        assert got.collect() == page(df, order, n, 13).collect()
        cursor = cursor_of(got, "name", descending)
    assert after(df, "name", cursor, descending).count() == 0 and cursor_of(df.limit(0), "name") is None


def test_cursor_is_a_pushed_predicate(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i:03}") for i in range(100)], "id long, name string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = after(df, "name", {"value": "n050", "key": 50})._jdf.queryExecution().toString()
    assert "GreaterThan(name,n050)" in plan
