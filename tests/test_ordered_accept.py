"""D4 / D12 / D13 decisions equal a plain sequential loop (brute force) on random inputs."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.plans.admission import admit_bills, breakpoints, clamped_accept, replay
from tillroll.plans.components import components

T0 = dt.datetime(2024, 1, 1)


def _sequential_admission(bills, stock):
    left = dict(stock)
    out = {}
    for bid, at, lines in sorted(bills, key=lambda b: (b[1], b[0])):
        need = {}
        for p, q in lines:
            need[p] = need.get(p, 0) + q
        if any(p not in left for p in need):
            out[bid] = False
        elif all(left[p] >= q for p, q in need.items()):
            for p, q in need.items():
                left[p] -= q
            out[bid] = True
        else:
            out[bid] = False
    return out


def test_admission_matches_sequential(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        stock = {p: rnd.randint(0, 12) for p in range(5)}
        bills = []
        for b in range(40):
            at = T0 + dt.timedelta(hours=rnd.randint(0, 96))
            lines = [(rnd.randint(0, 5), rnd.randint(1, 5)) for _ in range(rnd.randint(1, 3))]
            bills.append((b, at, lines))
        rows = [(b, p, q, at) for b, at, ls in bills for p, q in ls]
        lines = spark.createDataFrame(rows, "bill_id long, product_id long, quantity int, created_at timestamp_ntz")
        st = spark.createDataFrame(list(stock.items()), "product_id long, stock long")
        got = {r["bill_id"]: r["accepted"] for r in admit_bills(lines, st).collect()}
        assert got == _sequential_admission(bills, stock), seed


def _sequential_clamp(steps, opening):
    bal = dict(opening)
    out = {}
    for sid, key, at, d in sorted(steps, key=lambda s: (s[1], s[2], s[0])):
        b = bal.get(key, 0)
        if b + d >= 0:
            bal[key] = b + d
            out[sid] = (True, b, b + d)
        else:
            out[sid] = (False, b, None)
    return out


def test_clamped_accept_matches_sequential(spark):
    for seed in range(3):
        rnd = random.Random(100 + seed)
        opening = {k: rnd.randint(0, 20) for k in range(4)}
        steps = [(i, rnd.randint(0, 3), T0 + dt.timedelta(hours=rnd.randint(0, 72)), rnd.randint(-15, 10))
                 for i in range(60)]
        df = spark.createDataFrame(steps, "id long, product_id long, created_at timestamp_ntz, adjustment int")
        op = spark.createDataFrame(list(opening.items()), "id long, balance long")
        res = clamped_accept(df, op, "product_id", ["created_at", "id"], "adjustment")
        got = {r["id"]: (r["accepted"], r["balance_before"], r["balance_after"]) for r in res.collect()}
        assert got == _sequential_clamp(steps, opening), seed


def _chain(n):
    """Bill i wants products i and i + 1, one of each is in stock: whether it passes hangs on all bills before it."""
    return [(b, T0 + dt.timedelta(minutes=b), [(b, 1), (b + 1, 1)]) for b in range(n)], {p: 1 for p in range(n + 1)}


def _frames(spark, bills, stock):
    rows = [(b, p, q, at) for b, at, ls in bills for p, q in ls]
    return (spark.createDataFrame(rows, "bill_id long, product_id long, quantity int, created_at timestamp_ntz"),
            spark.createDataFrame(list(stock.items()), "product_id long, stock long"))


@pytest.mark.parametrize("n,most", [(10, 2), (100, 2), (1000, 2)])
def test_chain_takes_few_rounds(spark, n, most):
    bills, stock = _chain(n)
    got = admit_bills(*_frames(spark, bills, stock)).collect()
    assert {r["bill_id"]: r["accepted"] for r in got} == _sequential_admission(bills, stock)
    assert {r["rounds"] for r in got} <= set(range(1, most + 1))


def test_chain_longer_than_a_fold(spark):
    """Two chains, each cut into several folds; their groups are found by contraction."""
    bills, stock = _chain(20)
    bills += [(b + 100, at, [(p + 1000, q) for p, q in ls]) for b, at, ls in bills]
    stock |= {p + 1000: 1 for p in list(stock)}
    got = admit_bills(*_frames(spark, bills, stock), fold_lines=24, chunk_rows=7).collect()
    assert {r["bill_id"]: r["accepted"] for r in got} == _sequential_admission(bills, stock)
    assert got[0]["rounds"] <= 2


def test_admission_with_groups_matches_sequential(spark):
    rnd = random.Random(7)
    stock = {p: rnd.randint(0, 9) for p in range(30)}
    bills = [(b, T0 + dt.timedelta(hours=rnd.randint(0, 30)), [(rnd.randint(0, 29), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 3))])
             for b in range(90)]
    got = admit_bills(*_frames(spark, bills, stock), fold_lines=40, chunk_rows=11).collect()
    assert {r["bill_id"]: r["accepted"] for r in got} == _sequential_admission(bills, stock)


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-12, 8), max_size=25), st.integers(-5, 40))
def test_breakpoint_table_equals_replay(deltas, balance):
    starts, shifts = breakpoints(deltas)
    assert starts == sorted(starts)
    shift = [s for b, s in zip(starts, shifts) if b <= balance][-1]
    assert balance + shift == replay(balance, deltas)[2]


@pytest.mark.parametrize("chunk_rows", [3, 10])
def test_clamp_over_chunks_matches_sequential(spark, chunk_rows):
    """One hot key over many chunks, others within one."""
    rnd = random.Random(11)
    opening = {k: rnd.randint(0, 20) for k in range(4)}
    steps = [(i, rnd.choice([0, 0, 0, 1, 2, 3]), T0 + dt.timedelta(hours=rnd.randint(0, 72)), rnd.randint(-15, 10)) for i in range(90)]
    df = spark.createDataFrame(steps, "id long, product_id long, created_at timestamp_ntz, adjustment int")
    op = spark.createDataFrame(list(opening.items()), "id long, balance long")
    res = clamped_accept(df, op, "product_id", ["created_at", "id"], "adjustment", chunk_rows=chunk_rows)
    got = {r["id"]: (r["accepted"], r["balance_before"], r["balance_after"]) for r in res.collect()}
    assert got == _sequential_clamp(steps, opening)


# D4 as a keyed recursive CTE in DuckDB: one bill per step in arrival order, the
# consumed stock carried as a map.  Exact but sequential (minutes at sf0.01), so
# it is the test oracle on the smallest tables rather than a registered query.
D4_SQL = """
with recursive
ln as (select bill_id, product_id, cast(sum(quantity) as bigint) as q from bill_items group by 1, 2),
arr as (select x.bill_id, b.created_at, row_number() over (order by b.created_at, x.bill_id) as k
        from (select distinct bill_id from ln) x join bills b on b.id = x.bill_id),
need as (select a.k, a.bill_id, list(struct_pack(p := ln.product_id, q := ln.q, s := cast(p.stock_quantity as bigint)))
           as items
         from ln join arr a using (bill_id) left join products p on p.id = ln.product_id group by a.k, a.bill_id),
r(kind, k, bill_id, consumed, accepted) using key (kind, k) as (
  select 'S', 0, cast(null as bigint), cast(map() as map(bigint, bigint)), cast(null as boolean)
  union
  select * from (
    with cur as (select r.k + 1 as k, n.bill_id, r.consumed,
                   list_bool_and(list_transform(n.items, lambda x: x.s is not null
                        and coalesce(r.consumed[x.p], 0) + x.q <= x.s)) as ok, n.items
                 from r join need n on n.k = r.k + 1 where r.kind = 'S')
    select 'S', 0 + k, bill_id, case when ok then map_concat(consumed, map_from_entries(list_transform(items,
             lambda x: struct_pack(k := x.p, v := cast(coalesce(consumed[x.p], 0) + x.q as bigint))))) else consumed end, ok from cur
    union all
    select 'D', k, bill_id, cast(null as map(bigint, bigint)), ok from cur))
select bill_id, accepted from r where kind = 'D'
"""


def test_admission_matches_duckdb_recursive_oracle(spark):
    import duckdb

    from tests.conftest import SF_SMALL
    from tillroll.operators import ledger
    from tillroll.oracle import sql
    from tillroll.sources.catalog import Retail
    from tools.oracle_check import RAW

    con = duckdb.connect()
    for name in RAW:
        con.sql(f"create view {name} as select * from '{SF_SMALL}/{name}.parquet'")
    want = {r[0]: r[1] for r in con.sql(sql(D4_SQL)).fetchall()}
    t = Retail.from_testdata(spark, SF_SMALL)
    got = {r["bill_id"]: r["accepted"] for r in ledger.admit_orders(t, t.bills).collect()}
    assert got == want
