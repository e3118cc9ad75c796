"""How many partitions a frame needs.

``spark.sql.shuffle.partitions`` is one number for all inputs, so what a task sorts or
aggregates grows with the tables.  ``spread`` hash-partitions a frame on its keys into parts of about
``PART_ROWS`` rows; joins, aggregates and windows on those keys then run in as many tasks.  A frame that the
usual number of partitions holds is shuffled as usual, and adaptive execution puts its parts together.

``shuffled`` keeps a dimension out of a broadcast that its compressed file size would call for: a file of 5 MB can
hold more than a million rows, which the driver would collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

PART_ROWS, BROADCAST_ROWS = 500_000, 100_000


def rows_read(*frames: DataFrame) -> int:
    """The rows of the Parquet files that the frames read, from the file footers."""
    files = sorted({f for df in frames for f in df.inputFiles() if f.endswith(".parquet")})
    if not files:
        return 0
    return frames[0].sparkSession.read.option("recursiveFileLookup", "true").parquet(*files).count()


def parts_for(df: DataFrame, rows: int) -> int | None:
    """The partitions that so many rows need; None if the usual number holds them."""
    n = -(-rows // PART_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, parts: int | None, *keys) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def shuffled(df: DataFrame) -> DataFrame:
    """A dimension to join with; one of many rows is never broadcast whole."""
    return df.hint("merge") if rows_read(df) > BROADCAST_ROWS else df
