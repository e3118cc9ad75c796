"""Money and count aggregates with fixed result types.

Every report sum is ``decimal(18,2)`` and every mean is a double computed as
``double(exact decimal sum) / count`` so that two engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.sources.schema import TOTAL, MONEY


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    return col_(c).cast(MONEY)


def total(c) -> Column:
    """SUM of a money column as decimal(18,2); NULL over an empty input."""
    return F.sum(col_(c)).cast(TOTAL)


def total0(c) -> Column:
    """COALESCE(SUM(c), 0) as decimal(18,2)."""
    return F.coalesce(total(c), F.lit(0).cast(TOTAL))


def mean0(c) -> Column:
    """COALESCE(AVG(c), 0) as a double: double(exact sum) / count."""
    return F.coalesce(F.try_divide(F.sum(col_(c)).cast("double"), F.count(col_(c))), F.lit(0.0))


def qty0(c) -> Column:
    """COALESCE(SUM(int), 0) as bigint."""
    return F.coalesce(F.sum(col_(c)).cast("bigint"), F.lit(0).cast("bigint"))


def round_half_up(c, scale: int = 2) -> Column:
    return F.round(col_(c), scale)
