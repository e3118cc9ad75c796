"""Low-stock alerts are the same under every batch split and a restart; only movements behind the delay are late."""

import os
import shutil

from tests.conftest import SF_SMALL
from tillroll.sources.catalog import Retail
from tillroll.streaming import stock


def _alerts(store):
    return sorted(tuple(r) for r in store.read("alerts").collect())


def _sequential(t):
    left = {r["id"]: r["stock_quantity"] for r in t.products.collect()}
    least = {r["id"]: r["minimum_stock"] for r in t.products.collect()}
    out = []
    for r in sorted(stock.stock_events(t).collect(), key=lambda r: (r["created_at"], r["kind"], r["ref"])):
        p = r["product_id"]
        if p in left:
            now = left[p] + r["delta"]
            if left[p] > least[p] >= now:
                out.append((p, r["created_at"], r["kind"], r["ref"], now))
            left[p] = now
    return sorted(out)


def test_any_batch_split_and_restart(spark, tmp_path):
    t = Retail.from_testdata(spark, SF_SMALL)
    want = _sequential(t)
    folder = str(tmp_path / "events")
    stream = stock.event_files(stock.stock_events(t), folder, 3)
    whole = stock.finish(stock.monitor(stream, t.products, str(tmp_path / "one")))
    assert want and _alerts(whole) == want and whole.read("waiting").count() == 0
    # the files one after the other, in two runs under one root, in the order of their times
    part, root = str(tmp_path / "part"), str(tmp_path / "two")
    os.makedirs(part)
    names = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    schema = spark.read.parquet(folder).schema
    for k, step in enumerate((names[:1], names[1:])):
        for i, f in enumerate(step):
            shutil.copy(f"{folder}/{f}", part)
            os.utime(f"{part}/{f}", (1_000_000 + 10 * k + i, 1_000_000 + 10 * k + i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(part)
        store = stock.monitor(stream, t.products, root)
    assert store.describe()["batch"] >= 2 and store.read("late").count() == 0
    assert _alerts(stock.finish(store)) == want
