"""op12 against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.llm import hard_negatives as hn
from tillroll.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, step, positives=5, negatives=10):
    good = set()
    for i, e, lab in rows:
        if i is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.add((i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = []
    anchors = {}
    for r in sorted(good):
        if r[0] % step == 0:
            anchors.setdefault(r[0], r)
    for i, lab, e in anchors.values():
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, m) for j, m, f in good if j != i and len(f) == len(e))
        for p, pid, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(s, j) for s, j, m in scored if m != lab and -30 * p <= -100 * s <= -90 * p]
            out += [(i, pid, n, j, -p, -s) for n, (s, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(df, step, **kw):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in hn.mine(hn.usable(df), F.col("vec_id") % step == 0, **kw).collect())


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    return [(int(i), [round(float(x), 2) for x in rng.normal(0.3, 0.6, dim)], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("tile,anchors", [(16_384, 2_048), (40, 7)])
def test_any_cells(spark, tile, anchors):
    """Ties, copies of one vector, repeated rows, unusable rows and other lengths, in one cell and in many."""
    rows = vectors(3, 300) + [(1000 + i, [0.5] * 6, i % 4) for i in range(120)] + [(2000 + i, [0.0] * 6, 1) for i in range(5)]
    rows += [rows[10]] * 50 + [(10, [0.1] * 6, 2), (None, [1.0] * 6, 1), (3000, None, 1), (3010, [1.0] * 6, None),
                               (3020, [float("nan")] * 6, 1), (3030, [float("inf")] + [0.0] * 5, 1), (3040, [None] * 6, 1),
                               (4000, [1.0, -1.0], 1), (4001, [1.0, -0.9], 1), (4002, [0.5, -0.5], 2), (4010, [], 1), (4011, [], 1), (4012, [], 2)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    assert mined(df, 10, tile_rows=tile, anchor_rows=anchors) == brute(rows, 10)


def test_large_components(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [1.5e6, 7.0], 2), (3, [1.5e6, 8.0], 2), (4, [-1e6, 0.0], 2)]
    assert mined(spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA), 4) == brute(rows, 4) != []


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []


def test_whole_small_table(spark, small):
    rows = [(i, e, (lab + 1) % 10 if i % 7 == 0 else lab) for i, e, lab in small("embeddings", "vec_id, embedding, label")]
    got = queries.op12_hard_negatives(spark, SF_SMALL).collect()
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in cols) for r in got) == brute(rows, 100)


def test_reading_stops_early():
    """One dimension decides: the threshold falls below the k-th score long before the lists end."""
    rng = np.random.default_rng(5)
    vec = np.floor(np.concatenate([rng.normal(0, 300, (20_000, 1)), rng.normal(0, 1, (20_000, 3))], 1))
    lists = hn.SortedLists(np.arange(20_000), np.zeros(20_000, int), vec)
    scored = []
    real = hn._integers
    try:
        hn._integers = lambda x, kind: (scored.append(len(x)), real(x, kind))[1]
        (rows, scores), = lists.best(np.array([9.0, 1.0, 0.0, -1.0]), np.ones(20_000, bool), [(-math.inf, math.inf)], 10)
    finally:
        hn._integers = real
    want = vec @ np.array([9.0, 1.0, 0.0, -1.0])
    assert scores.tolist() == sorted(want, reverse=True)[:10]
    assert sum(scored) < 5_000
