"""Requests with nulls or unknown keys get a reason; none hangs a loop or vanishes."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import integrity, ledger
from tillroll.plans.admission import admit_bills, clamped_accept
from tillroll.plans.sequence import running_sum

T = dt.datetime(2024, 1, 1)


def test_admission(spark):
    lines = spark.createDataFrame([(1, 1, 2, T), (2, 1, None, T), (3, None, 1, T), (4, 1, 1, None), (None, 1, 1, T), (5, 1, 9, T), (6, 1, 3, T)],
                                  "bill_id long, product_id long, quantity int, created_at timestamp_ntz")
    stock = spark.createDataFrame([(1, 5)], "product_id long, stock int")
    got = {r["bill_id"]: (r["accepted"], r["reject_reason"]) for r in admit_bills(lines, stock, max_rounds=9).collect()}
    assert got == {1: (True, None), 2: (False, "quantity_not_positive"), 3: (False, "product_not_found"), 4: (False, "created_at_missing"),
                   None: (False, "bill_id_missing"), 5: (False, "insufficient_stock"), 6: (True, None)}


def test_clamped_accept(spark):
    steps = spark.createDataFrame([(1, 1, -3, T), (2, 1, None, T), (3, 9, 5, T), (4, None, 5, T), (5, 1, -1, None), (6, 1, -3, T), (7, 1, 1, T)],
                                  "id long, product_id long, adjustment int, created_at timestamp_ntz")
    opening = spark.createDataFrame([(1, 4)], "id long, balance int")
    got = {r["id"]: (r["accepted"], r["balance_after"], r["refused"]) for r in clamped_accept(
        steps, opening, "product_id", ["created_at", "id"], "adjustment").collect()}
    assert got == {1: (True, 1, None), 2: (False, None, "value_missing"), 3: (False, None, "key_not_found"), 4: (False, None, "key_not_found"),
                   5: (False, None, "time_missing"), 6: (False, None, None), 7: (True, 2, None)}


def test_running_sum_keeps_null_times(spark):
    df = spark.createDataFrame([(1, 1, 5, T), (2, 1, 7, None), (3, None, 2, T)], "id long, k long, v int, at timestamp_ntz")
    got = {r["id"]: r["running"] for r in running_sum(df, "k", ["at", "id"], "v", F.to_date("at")).collect()}
    assert got == {1: 12, 2: 7, 3: 2}


def test_create_is_sequential(spark):
    target = spark.createDataFrame([("old", "b0")], "sku string, barcode string")
    rows = [(1, "a", "b0"), (2, "a", "b1"), (3, "c", "b1"), (4, "c", "b2"), (5, "old", None), (6, "d", None), (7, "d", "b3"), (8, None, "b3")]
    batch = spark.createDataFrame(rows, "request_id long, sku string, barcode string")
    taken, want = {"sku": {"old"}, "barcode": {"b0"}}, {}
    for i, sku, barcode in rows:
        held = [c for c, v in (("sku", sku), ("barcode", barcode)) if v is not None and v in taken[c]]
        want[i] = bool(held)
        if not held:
            taken["sku"].add(sku), taken["barcode"].add(barcode)
    got = {r["request_id"]: r["conflict"] for r in integrity.unique_on_create(target, batch, ["sku", "barcode"]).collect()}
    assert {i: c is not None for i, c in got.items()} == want
    assert got[1] == "barcode_exists" and got[3] == "barcode_repeated_in_batch" and got[7] == "sku_repeated_in_batch"


def test_touch_keeps_other_rows(spark):
    target = spark.createDataFrame([(1, "x", "OLD"), (2, "y", "OLD"), (3, "z", "OLD")], "id long, email string, updated_at string")
    patch = spark.createDataFrame([(1, "new"), (2, "y")], "id long, email string")
    out, _ = integrity.apply_patch(target, patch, "id", ["email"], touch=F.lit("NOW"))
    assert {r["id"]: (r["email"], r["updated_at"], r["changed"]) for r in out.collect()} == {
        1: ("new", "NOW", True), 2: ("y", "NOW", False), 3: ("z", "OLD", False)}


def test_one_refund_for_each_payment(spark):
    class Tables:
        payments = spark.sql("select 1L id, 10L bill_id, cast(100 as decimal(12,2)) amount, 'cash' method, 'completed' status, "
                             "cast(null as string) gateway_transaction_id")
    req = spark.sql("select * from values (1L, 1L, cast(null as decimal(12,2)), timestamp_ntz'2024-01-02'), "
                    "(2L, 1L, cast(null as decimal(12,2)), timestamp_ntz'2024-01-01'), (3L, 1L, cast(500 as decimal(12,2)), timestamp_ntz'2023-01-01') "
                    "t(request_id, payment_id, amount, created_at)")
    rows, upd = ledger.refund_payments(Tables, req)
    assert [(r["id"], float(r["amount"])) for r in rows.collect()] == [(2, -100.0)] and upd.count() == 1
    assert {r["request_id"]: r["reject_reason"] for r in ledger.refund_decisions(Tables, req).collect()} == {
        1: "payment_already_refunded", 2: None, 3: "amount_exceeds_payment"}
