"""Hard-negative mining by Fagin's threshold algorithm.

Vectors are made integers and dealt to shards by a hash of ``vec_id``.  A shard
sorts its rows once per dimension.  An anchor reads these lists from the end its component's sign points
to (large values for a positive component, small ones for a negative), all lists to the same depth; every row met for the first time is
scored in full by random access to its vector.  The threshold, the score of a row that would stand at the lists' present
place in every dimension, bounds all rows not met.  Reading stops once it lies
strictly below the k-th score of every window asked for, or, where fewer are found, below the window's floor.

Two rounds, each shards x anchor groups cells and a two-level merge: the first finds an
anchor's best rows of its own label (lists per label); their scores fix the windows
``floor * positive <= 100 * negative <= ceil * positive`` of the second, which reads the lists of
all labels for the best rows of other labels.  A cell holds about ``tile_rows`` vectors and
``anchor_rows`` anchors at any input size; labels decide nothing about where rows go, so a label with a
third of all rows is spread like any other.  Depths double, so a row is met at most twice as deep as needed.

Defined cases: rows with a null ``vec_id`` or label, a null vector, or a null, NaN or infinite
component take no part; rows equal in id, label and vector are one row; other rows that share an
``vec_id`` are candidates each, but ask once, with the least label and vector; a row is never a candidate for an anchor with its id; only vectors of the anchor's
length are scored.  Equal scores go to the smaller ``vec_id``; a positive
below zero has no window.  Sums that could pass 2^53 are computed with Python integers; a score beyond 64 bits raises an error.  Other
columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

SCALE, POSITIVES, NEGATIVES, FLOOR, CEIL = 256, 5, 10, 30, 90
TILE_ROWS, ANCHOR_ROWS, LEAST_ROWS, FIRST_DEPTH = 16_384, 2_048, 512, 16
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long, shard int"


class SortedLists:
    """Rows of one shard and vector length, with every dimension's rows in ascending order of their values."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.largest = np.abs(vectors).max(initial=0)

    def best(self, anchor: np.ndarray, usable: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (least, most score) its k best usable rows and their scores; ids ascend with the row numbers."""
        n, exact = len(self.ids), np.float64
        if np.abs(anchor).max(initial=0) * self.largest * max(len(anchor), 1) >= 2.0 ** 53:
            exact = object  # sums of larger integers are not exact as doubles
        a = _integers(anchor, exact)
        dims = np.flatnonzero(anchor)
        met, score = np.zeros(n, bool), np.zeros(n, exact)
        depth, done = 0, not len(dims)  # without a component every score is zero
        if done:
            met[:] = True
        while not done:
            reach = min(max(2 * depth, FIRST_DEPTH), n)
            place = np.arange(depth, reach)[:, None]
            rows = np.where(anchor[dims] > 0, self.order[n - 1 - place, dims], self.order[place, dims])
            fresh = np.zeros(n, bool)
            fresh[rows.ravel()] = True
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            score[fresh] = _integers(self.vectors[fresh], exact).dot(a)
            depth = reach
            last = np.where(anchor[dims] > 0, self.values[n - depth, dims], self.values[depth - 1, dims])
            threshold = _integers(last, exact).dot(a[dims])
            done = depth == n or all(threshold < b for b in self._bounds(score, met & usable, windows, k))
        out = []
        seen = np.flatnonzero(met & usable)
        for low, high in windows:
            own = seen[(score[seen] >= low) & (score[seen] <= high)]
            own = own[np.argsort(-score[own], kind="stable")][:k]
            out.append((own, score[own]))
        return out

    @staticmethod
    def _bounds(score: np.ndarray, seen: np.ndarray, windows: list[tuple[float, float]], k: int) -> Iterator[float]:
        """The score below which no further row can enter a window."""
        found = np.sort(score[seen])
        for low, high in windows:
            at = np.searchsorted(found, high, "right")
            yield max(low, found[at - k]) if at >= k else low


def _integers(x: np.ndarray, kind: type) -> np.ndarray:
    return x if kind is np.float64 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _by_length(t: pa.Table) -> dict[int, np.ndarray]:
    """Vector length -> row numbers, ids ascending."""
    sizes, ids = np.asarray(t.column("v").combine_chunks().value_lengths()), t.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return {int(n): order[sizes[order] == n] for n in np.unique(sizes)}


def _matrix(t: pa.Table, rows: np.ndarray, n: int) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return np.floor(np.asarray(v.take(pa.array(rows)).flatten(), np.float64)).reshape(len(rows), n)


def _windows(a: dict, floor: int, ceil: int) -> list[tuple[int, int]]:
    """Least and most score of a negative, for every positive of an anchor."""
    return [(-(-floor * p // 100), ceil * p // 100) for p in a["scores"]]


def _cell(anchors: pa.Table, rows: pa.Table, k: int, negatives: tuple[int, int] | None, shard: int) -> pa.Table:
    """The k best rows of this shard for every anchor (and window) of one cell."""
    out: list[tuple] = []
    groups = _by_length(rows) if len(rows) and len(anchors) else {}
    labels = np.asarray(rows.column("label")) if groups else np.empty(0, np.int64)
    ids = rows.column("vec_id").to_numpy() if groups else np.empty(0, np.int64)
    asked = anchors.rename_columns([c.removeprefix("asked_") for c in anchors.column_names]).to_pylist() if groups else []
    for n, own in groups.items():
        vectors = _matrix(rows, own, n)
        lists: dict = {}
        for a in asked:
            if len(a["v"]) != n or (negatives and not a["scores"]):
                continue
            # Round one reads its label's lists only, round two those of all labels.
            name = None if negatives else a["label"]
            if name not in lists:
                pick = slice(None) if name is None else labels[own] == name
                lists[name] = SortedLists(ids[own][pick], labels[own][pick], vectors[pick])
            held = lists[name]
            if not len(held.ids):
                continue
            if negatives:
                usable, windows, tags = held.labels != a["label"], _windows(a, *negatives), list(zip(a["positives"], a["scores"]))
            else:
                usable, windows, tags = held.ids != a["vec_id"], [(-math.inf, math.inf)], [(None, None)]
            real = [i for i, (low, high) in enumerate(windows) if low <= high]
            found = held.best(np.floor(np.array(a["v"], np.float64)), usable & (held.ids != a["vec_id"]), [windows[i] for i in real], k) if real else []
            for i, (at, scores) in zip(real, found):
                out += [(a["vec_id"], *tags[i], int(held.ids[r]), int(s), shard) for r, s in zip(at, scores)]
    cols = list(zip(*out)) or [()] * 6
    kinds = [pa.int64()] * 5 + [pa.int32()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                ["anchor_id", "positive_id", "positive_score", "vec_id", "score", "shard"])


def _merged(found: DataFrame, keys: list[str], k: int, shards: int) -> DataFrame:
    """The k best over all shards, ranked; partial lists are merged in two levels."""
    order = [F.col("score").desc(), F.col("vec_id")]
    fan = max(math.isqrt(shards), 1)
    part = found.withColumn("part", F.pmod("shard", F.lit(fan)))
    for by in ([*keys, "part"], keys):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return part.drop("part", "shard")


def usable(vectors: DataFrame, scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """vec_id, label, v (scale * x as doubles; cells take the floor) of the rows that take part, each once."""
    x = F.col("embedding")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    # Spark's floor() gives a 64-bit integer, which large components do not fit.  Adding 0.0 makes a negative zero a zero.
    scaled = F.transform(x.cast("array<double>"), lambda e: F.lit(float(scale)) * e + F.lit(0.0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                       scaled.alias("v")).dropDuplicates()


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR,
         ceil: int = CEIL, tile_rows: int = TILE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over the rows of ``usable``."""
    rows = stored(rows, "mining-rows")
    asked = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")
    n, n_asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(math.ceil(n / tile_rows), min(parts, math.ceil(n / LEAST_ROWS)), 1)
    groups = max(math.ceil(n_asked / anchor_rows), 1)
    dealt = (rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
             .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))

    def cells(anchors: DataFrame, k: int, limits: tuple[int, int] | None) -> DataFrame:
        # New names, as both sides stem from the same rows; another seed than the shards', as an anchor's group says nothing about its shard.
        sent = (anchors.select(*[F.col(c).alias(f"asked_{c}") for c in anchors.columns]).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "asked_vec_id"), F.lit(groups)).cast("int"))
                .withColumn("asked_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumnRenamed("group", "asked_group"))
        return sent.groupBy("asked_shard", "asked_group").cogroup(dealt.groupBy("shard", "group")).applyInArrow(
            lambda key, a, c: _cell(a, c, k, limits, key[0].as_py()), _FOUND)

    best = _merged(cells(asked, positives, None), ["anchor_id"], positives, shards)
    pairs = stored(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("p"))  # k pairs at most
    second = asked.join(lists, asked["vec_id"] == lists["anchor_id"]).select(
        "vec_id", "label", "v", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))
    found = _merged(cells(second, negatives, (floor, ceil)), ["anchor_id", "positive_id", "positive_score"], negatives, shards)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))


def oracle_sql(step: int = 100, noisy: int = 7) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {noisy} = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
      FROM v a JOIN v c ON a.vec_id % {step} = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::int AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND {FLOOR} * positive_score <= 100 * s.score AND 100 * s.score <= {CEIL} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}"""
