"""The versioned store: whole versions through crashes, few files touched, replays, compaction, expiry."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.operators import apply
from tillroll.sources import workloads as W
from tillroll.sources.catalog import Retail
from tillroll.streaming.store import Append, Replace, Store, Update


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, n int")


def _content(df):
    return sorted(map(tuple, df.collect()), key=str)


def _paths(store, name):
    return {f["path"] for f in store.describe()["tables"][name]["files"]}


def test_update_writes_only_files_with_its_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"a": Replace(_rows(spark, [(i, f"x{i}", i) for i in range(400)]), "id")})
    before = _paths(store, "a")
    store.write({"a": Update(spark.createDataFrame([(7, -1), (8, None), (9999, 5)], "id long, n int"))})
    after = _paths(store, "a")
    assert len(before) > 4 and len(before - after) == 1  # keys 7 and 8 lie in one range
    want = [(i, f"x{i}", {7: -1, 8: None}.get(i, i)) for i in range(400)]
    assert _content(store.read("a")) == sorted(want, key=str)
    assert _content(store.read("a", 0)) == sorted([(i, f"x{i}", i) for i in range(400)], key=str)
    assert _content(store.lookup("a", spark.createDataFrame([(3,), (3,), (777,)], "id long"))) == [(3, "x3", 3)]


def test_update_may_insert(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"a": Replace(_rows(spark, [(1, "x", 1)]), "id")})
    store.write({"a": Update(spark.createDataFrame([(1, 5), (2, 6), (-3, 7)], "id long, n int"), insert=True)})
    assert _content(store.read("a")) == sorted([(1, "x", 5), (2, None, 6), (-3, None, 7)], key=str)


def test_readers_see_one_version_through_a_crash(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"a": Replace(_rows(spark, [(1, "x", 1)]), "id"), "b": Replace(_rows(spark, [(1, "y", 1)]), "id")}, batch=0)

    class Crash(Store):
        def _publish(self, version, content):
            raise OSError("the writer dies with all data files written and no version in place")

    with pytest.raises(OSError):
        Crash(spark, str(tmp_path)).write({"a": Append(_rows(spark, [(2, "x", 2)])), "b": Append(_rows(spark, [(2, "y", 2)]))}, batch=1)
    assert (_content(store.read("a")), _content(store.read("b"))) == ([(1, "x", 1)], [(1, "y", 1)])
    for _ in range(2):  # the batch again, and once more as a replay
        store.write({"a": Append(_rows(spark, [(2, "x", 2)])), "b": Append(_rows(spark, [(2, "y", 2)]))}, batch=1)
    assert _content(store.read("a")) == [(1, "x", 1), (2, "x", 2)] and _content(store.read("b")) == [(1, "y", 1), (2, "y", 2)]
    assert store.versions() == [0, 1]


def test_file_count_stays_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path), max_files=6, target_rows=50)
    rnd, want = random.Random(1), []
    store.write({"a": Replace(_rows(spark, []))})
    for batch in range(16):
        rows = [(batch * 10 + i, "r", rnd.randint(0, 9)) for i in range(3)]
        want += rows
        store.write({"a": Append(_rows(spark, rows).coalesce(1))}, batch)
        files = store.describe()["tables"]["a"]["files"]
        assert len([f for f in files if f["rows"] < 50]) <= 6
    assert _content(store.read("a")) == sorted(want, key=str)
    gone = store.expire(keep=2)
    assert gone > 0 and len(store.versions()) == 2 and _content(store.read("a")) == sorted(want, key=str)
    named = {p for v in store.versions() for f in store.describe(v)["tables"]["a"]["files"] for p in [f["path"]]}
    here = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "data") for f in fs if f.endswith(".parquet")}
    assert here == {p.split("file:", 1)[-1].replace("///", "/") for p in named}


def test_applied_operations_match_their_results(spark, tmp_path):
    """Voids and returns written back change exactly the rows that the operators report, twice the same batch once."""
    t = Retail.from_testdata(spark, SF_SMALL)
    store = Store(spark, str(tmp_path))
    apply.create(store, t, ["products", "customers", "bills", "bill_items", "returns"])
    stock = {r["id"]: r["stock_quantity"] for r in t.products.collect()}
    from tillroll.operators import ledger
    bills, back, _ = ledger.void_bills(t, W.void_requests(t.bills))
    for _ in range(2):
        apply.voids(store, W.void_requests(t.bills), batch=0)
    stock |= {r["id"]: r["stock_quantity"] for r in back.collect()}
    assert {r["id"]: r["stock_quantity"] for r in store.read("products").collect()} == stock
    voided = {r["id"] for r in bills.collect()}
    assert voided <= {r["id"] for r in store.read("bills").filter("status = 'voided'").collect()}
    now = apply.catalog(store)
    requests = W.return_requests(t.raw("lineitem"))
    checked = ledger.validate_returns(now, requests)
    stock |= {r["id"]: r["stock_quantity"] for r in ledger.apply_returns(now, checked)[1].collect()}
    n_before, n_new = store.read("returns").count(), checked.filter("reject_reason is null").count()
    apply.returns(store, requests, batch=1)
    assert n_new > 0 and store.read("returns").count() == n_before + n_new
    assert {r["id"]: r["stock_quantity"] for r in store.read("products").collect()} == stock


def test_a_whole_table_is_worked_out_and_written_once(spark, tmp_path):
    calls = []

    class Counting(Store):
        def _files(self, name, *args, **kwargs):
            calls.append(name)
            return super()._files(name, *args, **kwargs)

    store, seen = Counting(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    rows = [(i, f"x{i}", i) for i in range(600)] + [(None, "none", 1), (7, "again", 2)]
    df = _rows(spark, rows).withColumn("n", F.udf(count, "int")("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # more than a table keeps: these many files were compacted at once
    try:
        store.write({"a": Replace(df, "id", df.select("id"))})
        store.write({"a": Update(spark.createDataFrame([(i, -i) for i in range(0, 600, 5)], "id long, n int"))})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert calls == ["a", "a"] and seen.value == len(rows)
    for version in (0, 1):  # a key's rows are in one file, before and after
        files = sorted(store.describe(version)["tables"]["a"]["files"], key=lambda f: f["low"])
        assert 20 < len(files) <= 32 and all(a["high"] < b["low"] for a, b in zip(files, files[1:]))
    want = [(i, s, -i if i is not None and i % 5 == 0 else n) for i, s, n in rows]
    assert _content(store.read("a")) == sorted(want, key=str)
