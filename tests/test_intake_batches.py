"""The intake gives the same bills and rejects however its files fall into micro-batches."""

import os
import shutil

from tests.conftest import SF_SMALL
from tillroll.sources.catalog import Retail
from tillroll.streaming import intake


def _requests(spark, path):
    """Six files: good orders, one twice, broken and empty bodies, null fields; the last files hold the oldest orders."""
    os.makedirs(path)
    t = Retail.from_testdata(spark, SF_SMALL)
    lines = [r["value"] for r in intake.order_requests_json(t).limit(120).collect()]
    odd = ['{"request_id": 900001, "paymentMethod": "cash", "items": [{"productId": null, "quantity": 1}]}',
           '{"request_id": 900002, "paymentMethod": "cash", "items": [{"productId": 1, "quantity": null}]}',
           '{"request_id": 900003, "paymentMethod": "cash", "items": []}', '{"paymentMethod": "cash"}', "", "not json",
           '{"request_id": 900004, "paymentMethod": "cash", "discountAmount": 0, "items": [{"productId": 1, "quantity": 2}]}']
    lines = lines[::-1] + odd + lines[:30] + odd
    for i in range(6):
        with open(f"{path}/part-{i}.txt", "w") as f:
            f.write("\n".join(lines[i::6]) + "\n")
        os.utime(f"{path}/part-{i}.txt", (1_000_000 + i, 1_000_000 + i))
    return t


def _result(spark, root):
    return [sorted(map(tuple, intake.committed_rows(spark, root, n).select(*cols).collect()), key=str)
            for n, cols in (("bills", ["bill_id", "net_amount"]), ("rejects", ["request_id", "reject_reason"]))]


def test_any_batch_split_and_restart(spark, tmp_path):
    t = _requests(spark, str(tmp_path / "in"))
    whole = _result(spark, intake.run_intake(spark, t, str(tmp_path / "in"), 6))
    bills, rejects = whole
    ids = [i for i, _ in bills] + [i for i, _ in rejects if i is not None]
    assert len(ids) == len(set(ids)) and {900001, 900002, 900003, 900004} <= set(ids)
    reasons = dict(rejects)
    assert reasons[900001] == "product_not_found" and reasons[900002] == "quantity_not_positive"
    assert sum(r == "request_id_missing" for _, r in rejects) == 1 and 900004 in dict(bills)
    assert _result(spark, intake.run_intake(spark, t, str(tmp_path / "in"), 1)) == whole
    # stopped after half of the files, then taken up again under the same root
    part, root = tmp_path / "part", str(tmp_path / "root")
    os.makedirs(part)
    for step in ((0, 1, 2), (3, 4, 5)):
        for i in step:
            shutil.copy2(tmp_path / "in" / f"part-{i}.txt", part)
        intake.run_intake(spark, t, str(part), 2, root)
    assert _result(spark, root) == whole


def test_rejects_can_be_counted(spark):
    df = intake.parse_and_check(spark, Retail.from_testdata(spark, SF_SMALL))
    assert df.count() == len(df.collect()) == sum(r["count"] for r in df.groupBy("reject_reason").count().collect())


def test_a_micro_batch_is_worked_out_once(spark, tmp_path, monkeypatch):
    """The passes over a batch read its rows, not the stream's state, with adaptive execution; its files are gone afterwards."""
    t, seen, parse = _requests(spark, str(tmp_path / "in")), [], intake.parse_orders

    def parsing(raw):
        both = raw.select("request_id").join(raw.select("request_id", "paymentMethod"), "request_id")
        seen.append((raw.sparkSession.conf.get("spark.sql.adaptive.enabled"), both._jdf.queryExecution().executedPlan().toString(),
                     raw.inputFiles()))
        return parse(raw)

    monkeypatch.setattr(intake, "parse_orders", parsing)
    for run in (intake.run_intake, intake.run_checkout):
        seen.clear()
        run(spark, t, str(tmp_path / "in"), 3)
        assert len(seen) == 2
        for adaptive, plan, files in seen:
            assert adaptive == "true" and "ExistingRDD" not in plan and "AdaptiveSparkPlan" in plan
            assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
