"""Ordered accept/reject decisions, exact and in few rounds.

The source takes requests one at a time: a bill is refused when any of its
products is short, and a refused bill frees that stock for later bills; a
stock adjustment or a points redemption is refused when it would take the
balance below zero.  A running sum is not enough, because each decision
depends on which earlier requests were accepted.

Bills (D4) are decided in rounds of two passes:

* Bounds.  From the undecided and accepted bills before it (per product, in
  arrival order) each undecided bill gets a lower and an upper bound of what it will
  find; it is accepted when even the worst case passes and refused when even the best case fails.
* Folds.  The bills still open depend on each other only through products they
  share.  Connected components of those products (``plans.components``)
  split them into independent groups; each group's bills are decided in arrival order by
  one loop in one task, at most ``fold_lines`` lines of a group in a round.

So a component of any chain length is decided in one round if it has at most ``fold_lines`` lines; a
larger one takes a round per ``fold_lines`` lines that the bounds do not decide.
That rest is inherent: whether a bill passes can depend on every earlier bill.

Steps on one balance (D12, D13) take a fixed number of jobs.  The steps are numbered once in
key and time order and cut into chunks of ``chunk_rows``.  A chunk in which a key's history goes on is
summed up by a breakpoint table: the balance after the chunk as a function
of the balance before it.  Tables of a key are applied in turn, which gives every chunk
its true entry balance, and all chunks are replayed at once.

Running sums are split into chunks of the arrival order, so a product in a third of
all lines, or a micro-batch of a single day, is spread over many tasks.  State is
checkpointed to the shared checkpoint folder, so a lost executor recomputes from the last pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.plans.components import components
from tillroll.plans.sequence import global_row_number, running_sums
from tillroll.plans.spread import shuffled
from tillroll.session import checkpointed

FOLD_LINES, CHUNK_ROWS = 200_000, 50_000


# ------------------------------------------------------------------ D4

def _bounds(lines: DataFrame, state: DataFrame, chunk_rows: int) -> DataFrame:
    """(bill_id, verdict) of the undecided bills that their bounds decide."""
    live = _open_lines(lines, state, chunk_rows, ["qty", "_acc_qty"], ["upper", "_acc_run"])
    live = live.withColumn("lower", F.col("_acc_run") + F.col("qty"))
    verdict = live.groupBy("bill_id").agg(
        F.max((F.col("upper") > F.col("stock")).cast("int")).alias("_may_fail"),
        F.max((F.col("lower") > F.col("stock")).cast("int")).alias("_fails"))
    return verdict.select("bill_id", F.when(F.col("_fails") == 1, "R").when(F.col("_may_fail") == 0, "A").alias("verdict")
                          ).filter("verdict is not null")


def _open_lines(lines: DataFrame, state: DataFrame, chunk_rows: int, values: list[str], outs: list[str]) -> DataFrame:
    """Lines of undecided bills with running sums over the accepted and undecided lines of their product."""
    live = lines.join(state.filter(F.col("state") != "R").select("bill_id", "state"), "bill_id")
    # Only products that still carry undecided demand can change a decision.
    open_products = live.filter(F.col("state") == "U").select("product_id").distinct()
    live = live.join(open_products, "product_id", "left_semi")
    live = live.withColumn("_acc_qty", F.when(F.col("state") == "A", F.col("qty")).otherwise(F.lit(0)))
    live = running_sums(live, "product_id", ["seq"], values, F.floor(F.col("seq") / F.lit(chunk_rows)), outs)
    return live.filter(F.col("state") == "U")


def _fold(table: pa.Table) -> pa.Table:
    """Decide one group's bills one after another: a line's room is what accepted earlier bills leave of its product."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seq", "bill_id", "product_id", "qty", "room"))))
    used: dict[int, int] = {}
    bills, verdicts, at = [], [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        bill = rows[at:end]
        ok = all(used.get(p, 0) + qty <= room for _, _, p, qty, room in bill)
        if ok:
            for _, _, p, qty, _ in bill:
                used[p] = used.get(p, 0) + qty
        bills.append(bill[0][1])
        verdicts.append("A" if ok else "R")
        at = end
    return pa.table({"bill_id": pa.array(bills, pa.int64()), "verdict": pa.array(verdicts, pa.string())})


def _fold_groups(lines: DataFrame, state: DataFrame, chunk_rows: int, fold_lines: int) -> DataFrame:
    """(bill_id, verdict) of the first ``fold_lines`` undecided lines of every independent group."""
    live = checkpointed(_open_lines(lines, state, chunk_rows, ["_acc_qty"], ["_acc_run"]).select(
        "bill_id", "seq", "product_id", "qty", (F.col("stock") - F.col("_acc_run")).alias("room")))
    if live.count() <= fold_lines:  # one task holds them all: no groups are needed
        grouped = live.withColumn("component", F.lit(0).cast("long"))
        first = grouped
    else:
        hub = live.groupBy("bill_id").agg(F.min("product_id").alias("hub"))
        of = components(live.join(hub, "bill_id"), "hub", "product_id").withColumnRenamed("node", "_node")
        grouped = live.join(of, live.product_id == of._node).drop("_node")
        place = running_sums(grouped.withColumn("_one", F.lit(1)), "component", ["seq", "product_id"], ["_one"],
                             F.floor(F.col("seq") / F.lit(chunk_rows)), ["_place"])
        # Whole bills only: those whose last line is still within the bound (or the group's first bill).
        whole = place.groupBy("bill_id").agg(F.max("_place").alias("_end"), F.min("_place").alias("_begin")).filter(
            (F.col("_end") <= fold_lines) | (F.col("_begin") == 1)).select("bill_id")
        first = grouped.join(whole, "bill_id", "left_semi")
    return first.groupBy("component").applyInArrow(_fold, "bill_id long, verdict string")


def admit_bills(lines: DataFrame, stock: DataFrame, fold_lines: int = FOLD_LINES, chunk_rows: int = CHUNK_ROWS,
                max_rounds: int | None = None) -> DataFrame:
    """All-or-nothing admission of bills against product stock, in arrival order.

    ``lines``: (bill_id, product_id, quantity, created_at); several lines of a
    product in one bill are summed.  ``stock``: (product_id, stock).  Returns
    (bill_id, created_at, accepted, reject_reason, rounds).

    A bill with an unknown (or null) product, a null or non-positive quantity,
    or no arrival time is refused before any stock is looked at; lines without
    a bill id are refused as one row with a null ``bill_id``."""
    nameless = lines.filter(F.col("bill_id").isNull()).limit(1).select(
        "bill_id", F.lit(None).cast(lines.schema["created_at"].dataType).alias("created_at"), F.lit(False).alias("accepted"),
        F.lit("bill_id_missing").alias("reject_reason"))
    lines = lines.filter(F.col("bill_id").isNotNull())
    ln = lines.groupBy("bill_id", "product_id").agg(
        F.sum("quantity").alias("qty"), F.min(F.coalesce("quantity", F.lit(0))).alias("_minq"), F.min("created_at").alias("created_at"))
    st = stock.select("product_id", F.col("stock").cast("bigint").alias("stock"))
    ln = checkpointed(ln.join(shuffled(st), "product_id", "left"))
    bills = ln.groupBy("bill_id").agg(
        F.max(F.col("stock").isNull().cast("int")).alias("_unknown"), F.min("_minq").alias("_minq"),
        F.min("created_at").alias("arrived"))
    reason = (F.when(F.col("_unknown") == 1, "product_not_found").when(F.col("_minq") <= 0, "quantity_not_positive")
              .when(F.col("arrived").isNull(), "created_at_missing"))
    # One place in the arrival order for every bill: the order, and the chunks, of all running sums.
    state = checkpointed(global_row_number(bills.select("bill_id", "arrived", reason.alias("reject_reason")), ["arrived", "bill_id"], "seq")
                  .withColumn("state", F.when(F.col("reject_reason").isNull(), "U").otherwise("R")))
    open_bills = state.filter("state = 'U'").select("bill_id", "seq")
    ln = checkpointed(ln.join(open_bills, "bill_id").select("bill_id", "seq", "product_id", F.col("qty").cast("bigint").alias("qty"), "stock"))
    rounds = 0
    undecided = open_bills.count()
    while undecided:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"admission did not converge in {max_rounds} rounds")
        rounds += 1
        before = undecided
        for decide in (_bounds(ln, state, chunk_rows), None):
            verdict = decide if decide is not None else _fold_groups(ln, state, chunk_rows, fold_lines)
            new = F.coalesce("verdict", "state")
            state = checkpointed(state.join(verdict, "bill_id", "left").select(
                "bill_id", "arrived", "seq", new.alias("state"),
                F.when(F.col("verdict") == "R", F.lit("insufficient_stock")).otherwise(F.col("reject_reason")).alias("reject_reason")))
            undecided = state.filter(F.col("state") == "U").count()
            if not undecided:
                break
        if undecided == before:
            raise RuntimeError(f"a round decided none of {undecided} bills")
    out = state.select("bill_id", F.col("arrived").alias("created_at"), (F.col("state") == "A").alias("accepted"), "reject_reason")
    return out.unionByName(nameless).withColumn("rounds", F.lit(rounds))


# ------------------------------------------------------------------ D12, D13

_LEAST, _MOST = -(1 << 62), 1 << 62  # below and above every balance


def replay(balance: int, deltas: list[int]) -> tuple[list[bool], list[int], int]:
    """Apply steps in turn, skipping those that would go below zero: accepted, balance found, balance left."""
    accepted, found = [], []
    for d in deltas:
        found.append(balance)
        ok = balance + d >= 0 or d >= 0
        accepted.append(ok)
        if ok:
            balance += d
    return accepted, found, balance


def breakpoints(deltas: list[int]) -> tuple[list[int], list[int]]:
    """The balance left as a function of the balance found: from ``starts[i]`` on, it is the balance found + ``shifts[i]``.

    A step that is skipped below some balance splits the piece whose values reach across it; neighbours with equal shifts are one
    piece.  A step moves a shift that all pieces share; only pieces whose least value does not cover it are touched.
    """
    starts, shifts = np.array([_LEAST]), np.zeros(1, np.int64)
    shift, merged = 0, 64  # what all pieces share; the pieces at which neighbours are put together
    for d in deltas:
        shift += d
        if d >= 0:
            continue
        bound = -shift  # a piece takes the step from the balance bound - shifts[i] on
        low = np.flatnonzero(starts + shifts < bound)
        if not len(low):
            continue
        ends = np.append(starts[1:], _MOST)[low]
        cut = bound - shifts[low]
        split = low[cut < ends]
        at = cut[cut < ends]
        taken = shifts[split]
        shifts[low] -= d
        if len(split):
            starts, shifts = np.insert(starts, split + 1, at), np.insert(shifts, split + 1, taken)
            if len(starts) > merged:
                starts, shifts = _joined(starts, shifts)
                merged = 2 * len(starts) + 64
    starts, shifts = _joined(starts, shifts)
    return starts.tolist(), (shifts + shift).tolist()


def _joined(starts: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours with equal shifts as one piece."""
    keep = np.append(True, shifts[1:] != shifts[:-1])
    return starts[keep], shifts[keep]


_TABLE = "_key string, _chunk long, first_balance long, starts array<long>, shifts array<long>"


def _tables(t: pa.Table) -> pa.Table:
    """One row per key of a chunk: its balance left if the chunk holds the key's first step, else its breakpoint table."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("_seq", "_key", "_d", "_first", "_open"))))
    per: dict[str, list] = {}
    for _, key, d, first, balance in rows:
        per.setdefault(key, [first, balance, []])[2].append(d)
    chunk = t.column("_chunk")[0].as_py()
    out = [(k, chunk, replay(b, ds)[2], None, None) if first else (k, chunk, None, *breakpoints(ds)) for k, (first, b, ds) in per.items()]
    longs = pa.list_(pa.int64())
    kinds = (pa.string(), pa.int64(), pa.int64(), longs, longs)
    names = ("_key", "_chunk", "first_balance", "starts", "shifts")
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply a key's tables in chunk order; rows come sorted by key and chunk."""
    key, balance = None, 0
    for b in batches:
        out: list[tuple] = []
        for k, chunk, first, starts, shifts in zip(*(b.column(c).to_pylist() for c in ("_key", "_chunk", "first_balance", "starts", "shifts"))):
            if k != key:
                key, balance = k, first
                continue  # a key's first chunk begins with its opening balance
            out.append((k, chunk, balance))
            balance += shifts[bisect_right(starts, balance) - 1]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                         ["_key", "_chunk", "_entry"])


def _replay_chunk(t: pa.Table) -> pa.Table:
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("_key", "_seq", "_d", "_start"))))
    out: list[tuple] = []
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        ok, found, _ = replay(rows[at][3], [r[2] for r in rows[at:end]])
        out += zip([r[1] for r in rows[at:end]], ok, found)
        at = end
    cols = list(zip(*out))
    return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64())],
                                ["_rseq", "accepted", "balance_before"])


def clamped_accept(steps: DataFrame, opening: DataFrame, key: str, order: list[str], delta: str,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per ``key``, apply ``delta`` steps in ``order`` to a balance that
    starts at ``opening`` (id, balance); a step that would take the balance
    below zero is refused and skipped.  Returns ``steps`` plus ``accepted``,
    ``balance_before`` and ``balance_after`` (of accepted steps; the balance the
    refused step saw) and ``refused``.

    Steps that cannot be applied are refused first, with a null balance and a
    reason in ``refused``: ``key_not_found`` (null, or not in ``opening``),
    ``value_missing``, ``time_missing`` (any null order column)."""
    s = steps.withColumn("_d", F.col(delta).cast("bigint"))
    op = opening.select(F.col("id").alias("_k"), F.col("balance").cast("bigint").alias("_open"))
    s = s.join(op, s[key] == op._k, "left")
    untimed = F.lit(False)
    for c in order:
        untimed = untimed | F.col(c).isNull()
    s = s.withColumn("refused", F.when(F.col("_k").isNull(), "key_not_found").when(F.col("_d").isNull(), "value_missing")
                     .when(untimed, "time_missing")).drop("_k")
    s = s.withColumn("_key", F.col(key).cast("string"))
    out = lambda d, ok, before: d.select(
        *steps.columns, ok.alias("accepted"), before.alias("balance_before"),
        F.when(ok, before + F.col("_d")).alias("balance_after"), "refused")
    bad = out(s.filter("refused is not null"), F.lit(False), F.lit(None).cast("bigint"))
    # Numbered once by key and time; a chunk is so many neighbours, be they of one key or of many.
    good = s.filter("refused is null").withColumn("_open", F.coalesce("_open", F.lit(0)))
    num = global_row_number(good, ["_key", *order], "_seq").withColumn("_chunk", F.floor(F.col("_seq") / F.lit(chunk_rows)))
    num = checkpointed(num)
    ends = num.groupBy("_key").agg(F.min("_chunk").alias("_c0"), F.max("_chunk").alias("_c1"))
    num = num.join(ends, "_key").withColumn("_first", F.col("_chunk") == F.col("_c0"))
    tables = num.filter("_c1 > _c0").select("_key", "_chunk", "_seq", "_d", "_first", "_open").groupBy("_chunk").applyInArrow(_tables, _TABLE)
    entries = tables.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInArrow(_entries, "_key string, _chunk long, _entry long")
    entries = entries.select(F.col("_key").alias("_ek"), F.col("_chunk").alias("_ec"), "_entry")
    start = num.join(entries, (num._key == entries._ek) & (num._chunk == entries._ec), "left").withColumn(
        "_start", F.coalesce("_entry", "_open"))
    done = start.select("_key", "_chunk", "_seq", "_d", "_start").groupBy("_chunk").applyInArrow(
        _replay_chunk, "_rseq long, accepted boolean, balance_before long")
    good = num.join(done, num._seq == done._rseq)
    return out(good, F.col("accepted"), F.col("balance_before")).unionByName(bad)
