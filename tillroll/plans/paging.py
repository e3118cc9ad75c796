"""Sorted pages and top-k.

``ORDER BY ... LIMIT k OFFSET o`` plans as TakeOrderedAndProject: each task
keeps its best ``o + k`` rows, so no full sort and no single-partition
shuffle.  Every order gets the primary key appended as a tie-break so that a
page is deterministic (quirk Q14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(order: list[Column], key: str | None) -> list[Column]:
    return order + ([F.col(key).asc_nulls_last()] if key else [])


def top_k(df: DataFrame, order: list[Column], k: int, key: str | None = "id") -> DataFrame:
    return df.orderBy(*ordered(order, key)).limit(k)


def page(df: DataFrame, order: list[Column], page_no: int = 1, limit: int = 20,
         key: str | None = "id") -> DataFrame:
    """Rows ``(page_no-1)*limit .. page_no*limit`` of ``df`` under ``order``."""
    off = max(page_no - 1, 0) * limit
    s = df.orderBy(*ordered(order, key))
    return (s.offset(off) if off else s).limit(limit)


def cursor_of(rows: DataFrame, column: str, descending: bool = False, key: str = "id") -> dict | None:
    """Where a page ends: the sort value and key of its last row (a page is at most ``limit`` rows); None for an empty page."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    last = rows.select(column, key).orderBy(*ordered([order], key)).tail(1)
    return {"value": last[0][0], "key": last[0][1]} if last else None


def after(df: DataFrame, column: str, cursor: dict | None, descending: bool = False, key: str = "id") -> DataFrame:
    """The rows that come after a cursor when sorted by ``column`` (nulls last), then ``key``.

    A predicate on the sort column that a scan can push, so page n reads and keeps as much as page 1
    would of what is left; an offset page keeps all the rows before it as well."""
    if cursor is None:
        return df
    c, v = F.col(column), F.lit(cursor["value"]).cast(df.schema[column].dataType)
    if cursor["value"] is None:
        return df.filter(c.isNull() & (F.col(key) > cursor["key"]))
    past = (c < v) if descending else (c > v)
    return df.filter((past | (c == v) | c.isNull()) & (past | c.isNull() | (F.col(key) > cursor["key"])))


def paginate(df: DataFrame, order: list[Column], page_no: int = 1, limit: int = 20,
             key: str | None = "id", count_df: DataFrame | None = None, page_df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): the page plus a one-row frame with the total row count.

    ``page_df`` (``df`` after a cursor) is what the page is cut from, the total is always of all.

    ``count_df`` lets the caller count on the filtered fact table without the
    dimension joins (they do not change the count).
    """
    total = (count_df if count_df is not None else df).agg(F.count(F.lit(1)).alias("total"))
    return page(df if page_df is None else page_df, order, page_no, limit, key), total


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int,
                    key: str | None = "id", rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` lets Spark insert a
    partial WindowGroupLimit before the shuffle, so a hot group ships at most
    k rows per map task instead of all of its rows."""
    w = Window.partitionBy(group).orderBy(*ordered(order, key))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
