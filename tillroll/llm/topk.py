"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt to a grid of (query group, candidate group)
cells.  A cell is one tiled matrix product of integer components in one task,
cut at once to the k best candidates per query (partial selection).  The short
lists are merged in two levels per query.

The two group counts follow the row counts, so a cell holds at most about
``query_rows`` x ``tile_rows`` vectors at any input size.  Each query is sent to
every candidate group and each candidate to every query group; nothing is
broadcast or collected, and no key can grow hot (rows are dealt in turn).

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with a null ``vec_id`` (they have no id to report);
only vectors of the same length are scored; each row is a candidate (a repeated
row is one more), but never for a query with its own ``vec_id``; a ``vec_id``
repeated among the queries asks once, with its smallest vector.  Equal scores
go to the smaller ``vec_id``.  Sums that could pass 2^53 are computed with
Python integers; a score beyond 64 bits raises an error.  Other columns are not
read.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TILE_ROWS, QUERY_ROWS, LEAST_ROWS = 32_768, 4_096, 512


def _usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def _by_length(t: pa.Table, ids: str, vecs: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (ids ascending, matrix of floor(SCALE * x) as float64)."""
    ids, vecs = t.column(ids).to_numpy(), t.column(vecs).combine_chunks()
    flat = np.floor(SCALE * np.asarray(vecs.flatten(), dtype=np.float64))
    sizes = np.asarray(vecs.value_lengths())
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = {}
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(dim)] = ids[rows], flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)  # every partial sum is an integer below 2^53: exact
    exact = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
    big = exact(q).dot(exact(c).T)
    if max(abs(v) for v in big.flat) >= 2 ** 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return big.astype(np.int64)


def _best_of_tile(queries: pa.Table, candidates: pa.Table, k: int, block: int = 256) -> pa.Table:
    """query_id, vec_id, score of the k best candidates for each query of one cell."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cands = _by_length(candidates, "vec_id", "embedding") if len(candidates) and len(queries) else {}
    for dim, (q_ids, q) in (_by_length(queries, "query_id", "query").items() if cands else ()):
        if dim not in cands:
            continue
        ids, c = cands[dim]
        for at in range(0, len(q_ids), block):
            score = _scores(q[at:at + block], c)
            for own, s in zip(q_ids[at:at + block], score):
                keep = np.flatnonzero(ids != own)
                if len(keep) > k:
                    bound = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[s[keep] >= bound]
                keep = keep[np.argsort(-s[keep], kind="stable")][:k]  # ids ascend: ties keep the smaller id
                out.append((np.full(len(keep), own, np.int64), ids[keep], s[keep]))
    cols = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols)})


def search(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = TILE_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where ``is_query`` holds."""
    good = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = good.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    n, n_q = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c_groups = max(math.ceil(n / tile_rows), min(parts, math.ceil(n / LEAST_ROWS)), 1)
    q_groups = max(math.ceil(n_q / query_rows), 1)
    turn = F.monotonically_increasing_id()
    left = (asked.withColumn("q_cell", F.pmod(F.xxhash64("query_id"), F.lit(q_groups)).cast("int"))  # the same in a recomputed task
            .withColumn("c_cell", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1)))))
    right = (good.withColumn("cg", F.pmod(turn + F.spark_partition_id(), F.lit(c_groups)).cast("int"))
             .withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1)))))

    def cell(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        best = _best_of_tile(q, c, k)
        return best.append_column("cg", pa.array([key[0].as_py()] * len(best), pa.int32()))

    short = left.groupBy("c_cell", "q_cell").cogroup(right.groupBy("cg", "qg")).applyInArrow(
        cell, "query_id long, vec_id long, score long, cg int")
    order = [F.col("score").desc(), F.col("vec_id")]
    fan = max(math.isqrt(c_groups), 1)
    merged = short.withColumn("part", F.pmod("cg", F.lit(fan))).withColumn(
        "r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(step: int = 100, k: int = 10) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
      FROM v q JOIN v c ON q.vec_id % {step} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
