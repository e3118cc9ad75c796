"""Bulk search and key lookups against brute force; report bundles; logins."""

import random
import re

import pytest

from tests.conftest import SF_SMALL
from tillroll import Retail
from tillroll.operators import carts, integrity, listing, reports
from tillroll.plans.joins import lookup_codes


@pytest.fixture(scope="module")
def t(spark):
    return Retail.from_testdata(spark, SF_SMALL)


def ilike(text, term):
    """Whether ``text`` holds the ILIKE pattern ``term`` (between two ``%``)."""
    if text is None:
        return False
    out, p, i = "", f"%{term}%", 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            i += 1
            out += re.escape(p[i].lower())
        else:
            out += {"%": ".*", "_": "."}.get(p[i], re.escape(p[i].lower()))
        i += 1
    return re.fullmatch(out, text.lower(), re.S) is not None


def test_bulk_search_against_brute_force(spark, t):
    rows = t.products.select("id", "name", "sku", "barcode", "is_active").collect()
    rng = random.Random(3)
    terms = ["%", "_", "____________", "_%_", r"\%", r"\_", "a\\", r"a\b", "SKU", "sku1", "zzz", "z", rows[0]["barcode"], "", None]
    for r in rng.sample(rows, 60):
        w = rng.choice([r["name"], r["sku"]])
        a = rng.randrange(len(w))
        x = w[a:a + rng.randint(1, 8)]
        at = rng.randrange(len(x) + 1)
        terms += [x.upper(), x[:at] + rng.choice(["%", "_", "%%", "_%"]) + x[at + 1:]]
    got: dict = {}
    for r in listing.bulk_product_search(t, spark.createDataFrame([(x,) for x in terms], "term string"), 7).collect():
        got.setdefault(r["term"], []).append((r["rank"], r["id"]))
    for term in terms:
        want = sorted((r["name"], r["id"]) for r in rows if term and r["is_active"] and (
            ilike(r["name"], term) or ilike(r["sku"], term) or r["barcode"] == term))[:7]
        assert sorted(got.get(term, [])) == [(n + 1, i) for n, (_, i) in enumerate(want)], term


def test_lookup_prefers_earlier_key_then_ties(spark):
    target = spark.createDataFrame([(1, "x", 5, "one"), (2, "x", 3, "two"), (3, "1", 1, None)], "id int, alt string, at int, v string")
    asked = spark.createDataFrame([("1",), ("x",), ("q",), (None,)], "code string")
    got = {r["code"]: (r["matched_id"], r["val"]) for r in lookup_codes(asked, "code", target, "id", ["id", "alt"], {"v": "val"}, ["at"]).collect()}
    assert got == {"1": (1, "one"), "x": (2, "two"), "q": (None, None), None: (None, None)}
    assert [r["matched_id"] for r in lookup_codes(asked.where("code = 'x'"), "code", target, "id", ["alt"]).collect()] == [1]


def test_totals_build_no_page(t):
    plan = listing.bills_total(t, status="completed")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Scan ExistingRDD" not in plan
    assert listing.bills_total(t, customer_id=1).first()["total"] == t.bills.where("customer_id = 1").count()


def test_foreign_keys_count_orphans(spark, t):
    class Broken:
        def __init__(self):
            self.spark = spark

        def table(self, name):
            df = t.table(name)
            return df.where("id <> 1") if name == "products" else df
    got = {(r[0], r[1]): r["orphans"] for r in integrity.check_foreign_keys(Broken()).collect()}
    assert len(got) == len(integrity.FOREIGN_KEYS)
    assert got["bill_items", "product_id"] == t.bill_items.where("product_id = 1").count() > 0
    assert got["bill_items", "bill_id"] == 0


def test_bundles_hold_every_frame_with_default_periods(t):
    as_of = "2001-07-18 12:00:00"
    frames = {"daily": 4, "weekly": 2, "monthly": 3, "tax": 2, "department": 1, "product": 1, "cashier": 1,
              "top-products": 1, "top-customers": 1, "dashboard": 5, "no-such-report": 5}
    for name, n in frames.items():
        assert len(reports.bundle(t, name, as_of)) == n
    same = reports.tax_summary(t, "2001-06-18", "2001-07-18").collect()
    assert reports.bundle(t, "tax", as_of)["summary"].collect() == same and same[0]["total_bills"] > 0
    assert reports.bundle(t, "monthly", as_of)["summary"].collect() == reports.monthly_summary(t, 2001, 7).collect()
    assert reports.bundle(t, "daily", as_of, date="2000-08-03")["summary"].collect() == reports.daily_summary(t, "2000-08-03").collect()
    assert reports.bundle(t, "dashboard", as_of)["recent_bills"].count() == 10


def test_logins_only_move_forward(spark):
    users = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2001-01-05 00:00:00'), (2, NULL), (3, TIMESTAMP_NTZ '2001-01-05 00:00:00')
                         AS u(id, last_login)""")
    logins = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2001-01-04 00:00:00'), (2, TIMESTAMP_NTZ '2001-01-02 00:00:00'),
                          (2, TIMESTAMP_NTZ '2001-01-03 00:00:00'), (9, TIMESTAMP_NTZ '2001-01-03 00:00:00') AS l(user_id, ts)""")
    got = {r["id"]: str(r["last_login"]) for r in carts.record_logins(users, logins).collect()}
    assert got == {1: "2001-01-05 00:00:00", 2: "2001-01-03 00:00:00", 3: "2001-01-05 00:00:00"}
