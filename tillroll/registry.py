"""Registered queries: name -> (Spark builder over a Retail catalog, DuckDB oracle SQL).

The Spark side calls the library; the oracle side states the operator
in SQL (reports: sets aggregated before any join) against the model CTEs of ``tillroll.oracle``, with explicit
casts so both engines return the same types (sums decimal(18,2), counts
bigint, means double).  Names carry the SURVEY §2 id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tillroll import oracle

# Report parameters (FIXTURES §5) used by every registered query.
AS_OF = "2001-07-18 12:00:00"
DAY = "2000-08-03"
WEEK_START = "2000-07-31"
YEAR, MONTH = 2000, 5
START, END = "2000-05-01", "2000-05-31"

_Q: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = (fn, oracle.sql(sql) if sql else None)
        return fn
    return deco


def S0(c: str) -> str:
    """COALESCE(SUM(c), 0) as decimal(18,2)."""
    return f"cast(coalesce(sum({c}), 0) as decimal(18,2))"


def S(c: str) -> str:
    return f"cast(sum({c}) as decimal(18,2))"


def A0(c: str) -> str:
    """COALESCE(AVG(c), 0) as double(exact sum) / count."""
    return f"coalesce(cast(sum({c}) as double) / nullif(count({c}), 0), 0.0)"


def Q0(c: str) -> str:
    return f"cast(coalesce(sum({c}), 0) as bigint)"


DAY_PRED = f"cast(created_at as date) = date '{DAY}' and status = 'completed'"
MONTH_PRED = f"extract(year from created_at) = {YEAR} and extract(month from created_at) = {MONTH} and status = 'completed'"
RANGE_PRED = f"created_at between timestamp '{START} 00:00:00' and timestamp '{END} 00:00:00' and status = 'completed'"


def _b(pred: str) -> str:
    """Prefix the bill columns of a predicate with ``b.``."""
    return (pred.replace("created_at", "b.created_at").replace("status =", "b.status ="))


FIG = f"count(*) as total_transactions, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax, " \
      f"{S0('discount_amount')} as total_discounts, {A0('net_amount')} as avg_transaction_value"


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in _Q.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _Q.items() if v[1]}


_loaded = False


def _load():
    global _loaded
    if not _loaded:
        _loaded = True
        from tillroll import registry_queries  # noqa: F401  (registers on import)


def run(name: str, t) -> DataFrame:
    _load()
    return _Q[name][0](t)
