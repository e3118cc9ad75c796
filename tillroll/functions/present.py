"""Presentation columns of the bill list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WALK_IN = "Walk-in"


def customer_label(name) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(WALK_IN))


def status_badge(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "completed", "success").otherwise("warning")
