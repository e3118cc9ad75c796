"""Distributed numbering and running sums that never route a whole table, or a
whole hot key, through one task.

``global_row_number`` — a 1-based position under a total order.  A plain
``row_number().over(Window.orderBy(...))`` moves every row into a single
partition; instead the rows are range-partitioned on the order (sampled
bounds, so even a hot date is split), numbered inside each partition with
``monotonically_increasing_id`` and shifted by the row counts of the earlier
partitions (one row per partition, a proven-small broadcast).  The numbered
frame is checkpointed to the shared checkpoint folder so a lost executor
cannot re-derive different ids.

``running_sum`` — per key, the running total of a value in a given order,
split by a chunk column (e.g. the day): the window runs per (key, chunk) and
each chunk is offset by the totals of the key's earlier chunks, so a key
holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.plans.spread import parts_for, rows_read, spread
from tillroll.session import checkpointed


def global_row_number(df: DataFrame, order: list[str], out: str = "seq",
                      partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = checkpointed(s)
    part = F.shiftright("_mid", 33)
    s = s.withColumn("_part", part).withColumn("_local", F.col("_mid") - F.shiftleft(part, 33))
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (s.join(F.broadcast(offsets), "_part", "inner")
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1)
            .drop("_mid", "_part", "_local", "_off"))


def running_sums(df: DataFrame, key: str, order: list[str], values: list[str], chunk: Column,
                 outs: list[str], rows: int | None = None) -> DataFrame:
    """Several running totals in one pass: ``outs[i]`` = sum of ``values[i]`` over rows
    of the same ``key`` up to and including this row (one window, one chunk
    aggregate, one offset join for all of them).  Rows with a null key or chunk are kept; a
    null chunk comes first.  The (key, chunk) groups are dealt to parts whose number grows with ``rows`` (by default,
    the rows of the files that ``df`` reads)."""
    d = df.withColumn("_chunk", chunk)
    parts = parts_for(df, rows_read(df) if rows is None else rows)
    d = spread(d, parts, key, "_chunk") if parts else d
    within = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for v, o in zip(values, outs):
        d = d.withColumn(f"_in_{o}", F.sum(v).over(within))
    chunk_tot = d.groupBy(key, "_chunk").agg(*[F.sum(v).alias(f"_tot_{o}") for v, o in zip(values, outs)])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = chunk_tot.select(F.col(key).alias("_okey"), F.col("_chunk").alias("_ochunk"), *[F.coalesce(F.sum(f"_tot_{o}").over(before), F.lit(0)).alias(f"_off_{o}")
                                             for o in outs])
    d = d.join(offs, F.col(key).eqNullSafe(F.col("_okey")) & F.col("_chunk").eqNullSafe(F.col("_ochunk")), "inner")
    for o in outs:
        d = d.withColumn(o, F.col(f"_off_{o}") + F.col(f"_in_{o}"))
    return d.drop("_chunk", "_okey", "_ochunk", *[f"_in_{o}" for o in outs], *[f"_off_{o}" for o in outs])


def running_sum(df: DataFrame, key: str, order: list[str], value: str, chunk: Column,
                out: str = "running", rows: int | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same ``key`` up to and including this row."""
    return running_sums(df, key, order, [value], chunk, [out], rows)
