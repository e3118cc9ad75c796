"""Loyalty tier rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier thresholds in points, and points per currency unit.
PLATINUM, GOLD, SILVER = 10000, 5000, 1000
CURRENCY_PER_POINT = 10
POINT_VALUE = "0.50"          # redemption value of one point


def tier(points) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return (F.when(p >= PLATINUM, "platinum").when(p >= GOLD, "gold")
            .when(p >= SILVER, "silver").otherwise("bronze"))


def points_to_next_tier(stored_tier, points) -> Column:
    """Distance to the next tier judged by the *stored* tier (may be negative when stale)."""
    t = F.col(stored_tier) if isinstance(stored_tier, str) else stored_tier
    p = F.col(points) if isinstance(points, str) else points
    return (F.when(t == "bronze", SILVER - p).when(t == "silver", GOLD - p)
            .when(t == "gold", PLATINUM - p).otherwise(F.lit(0))).cast("int")


def points_for(net) -> Column:
    """floor(net / 10) points for one bill, as int (per bill, never on a sum)."""
    n = F.col(net) if isinstance(net, str) else net
    return F.floor(n / CURRENCY_PER_POINT).cast("int")
