import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, query string"


def brute(rows, is_query, k):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v, *_ in rows:
        if i is not None and is_query(i) and v is not None and all(x is not None and math.isfinite(x) for x in v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        qi = [math.floor(1024 * float(x)) for x in v]
        best = sorted((-sum(a * b for a, b in zip(qi, c)), i) for i, c in good if i != q and len(c) == len(qi))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile,queries", [(32_768, 4_096), (40, 3)])
def test_against_brute_force(spark, tile, queries):
    rng = np.random.default_rng(1)
    vec = lambda d: [float(np.float32(x)) for x in np.round(rng.normal(size=d), 1)]
    rows = [(i, vec(6), 0, "q") for i in range(120)] + [(i, vec(3), 0, "q") for i in range(200, 215)]
    rows += [(300, None, 0, "q"), (301, [None] * 6, 0, "q"), (302, [float("nan")] * 6, 0, "q"), (303, [float("inf")] * 6, 0, "q"),
             (None, vec(6), 0, "q"), (304, [], 0, "q"), (310, [], 0, "q"), *[rows[5]] * 4, *[rows[10]] * 2, (20, vec(6), 0, "q")]
    rows += [(400 + i, rows[0][1], 0, "q") for i in range(30)]  # ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.search(df, F.col("vec_id") % 10 == 0, 10, tile, queries)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 10)


def test_large_components_and_empty(spark):
    rows = [(0, [1e6, -1e6], 0, "q"), (1, [1e6, 1.0], 0, "q"), (2, [-1e6, 0.5], 0, "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.search(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0, 10)
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0
