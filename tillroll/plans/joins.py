"""Join shapes used across the operators.

* ``lookup_codes`` — an OR over several key columns (``id = x OR sku = x OR
  barcode = x``) re-expressed as an equi-join: unpivot the keys into
  ``(code, key_rank, id)`` rows and join on ``code``, keeping the best rank.
  An OR condition would otherwise plan as a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def and_all(preds: list[Column | None]) -> Column:
    """Fold optional predicates with AND; no predicate means TRUE."""
    out = F.lit(True)
    for p in preds:
        if p is not None:
            out = out & p
    return out


def unpivot_codes(df: DataFrame, id_col: str, code_cols: list[str], keep: list[str]) -> DataFrame:
    """(code, rank, _id, _keep) for every non-null code column, rank = position in ``code_cols``."""
    pairs = [F.struct(F.col(c).cast("string").alias("code"), F.lit(i).alias("rank"))
             for i, c in enumerate(code_cols)]
    kept = F.struct(*[F.col(c) for c in dict.fromkeys(keep)]) if keep else F.lit(None)
    return (df.select(F.col(id_col).alias("_id"), kept.alias("_keep"), F.explode(F.array(*pairs)).alias("_k"))
            .select(F.col("_k.code").alias("code"), F.col("_k.rank").alias("rank"), "_id", "_keep")
            .filter(F.col("code").isNotNull()))


def lookup_codes(requests: DataFrame, code_col: str, target: DataFrame, id_col: str,
                 code_cols: list[str], payload: dict[str, str] | None = None,
                 ties: list[str] | None = None) -> DataFrame:
    """Resolve each request's code against any of ``code_cols`` of ``target``.

    Returns the request columns plus ``matched_id`` (null when nothing
    matches) and the matched row's ``payload`` (target column -> output name).
    When a code matches several rows (different key columns or
    duplicate alternate keys) the earliest key column wins, then the
    smallest ``ties`` and id — deterministic, never a fan-out.  The payload
    travels in the unpivoted row, so the target is scanned once and not
    joined a second time.
    """
    payload = payload or {}
    idx = unpivot_codes(target, id_col, code_cols, [*(ties or []), *payload])
    lead = [*[F.col(f"_keep.{c}").alias(f"_tie{i}") for i, c in enumerate(ties or [])], F.col("_id")]
    best = (idx.groupBy("code")
            .agg(F.min(F.struct("rank", *lead, F.struct(*[F.col(f"_keep.{c}").alias(a) for c, a in payload.items()]).alias("_out")
                                if payload else F.lit(0).alias("_out"))).alias("_best"))
            .select(F.col("code").alias("_code"), F.col("_best._id").alias("matched_id"),
                    *[F.col(f"_best._out.{a}").alias(a) for a in payload.values()]))
    return requests.join(best, requests[code_col] == best["_code"], "left").drop("_code")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], latest: bool = False) -> DataFrame:
    """The first (or with ``latest`` the last) row per ``keys`` under ``order``.

    An aggregate of ``min``/``max`` over a struct led by the order columns,
    so it combines map-side: a key holding a third of all rows is reduced in
    every task before the shuffle instead of being sorted in one window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.max if latest else F.min
    return (df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in order + rest]))
