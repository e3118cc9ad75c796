import zlib

import numpy as np

from tillroll.llm import queries, toxicity
from tests.conftest import SF_MID, SF_SMALL


def brute_segments(scores):
    """All maximal-scoring segments by their recursive definition."""
    if not len(scores):
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, n = -best[2], -best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[a + n:])
    return left + [(a, a + n - 1, best[0])] + [(x + a + n, y + a + n, s) for x, y, s in right]


def test_segments_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        scores = [float(x) if x > 0 else -0.3 for x in rng.normal(-0.5, 1, n)]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert np.allclose([s for *_, s in got], [s for *_, s in brute_segments(scores)])


def test_least_evidence():
    """The bar counts only words that can reach it."""
    assert toxicity._least_evidence([], 0.1) == np.inf and toxicity._least_evidence([(1, 1000)], 0.1) == np.inf
    assert np.isclose(toxicity._least_evidence([(1, 1000), (4, 50), (2, 90)], 0.1), np.log(50))
    assert np.isclose(toxicity._least_evidence([(1, 10**6), (9, 1), (5, 20)], 0.1), np.log(21))


def test_small_tables_still_teach(spark):
    """Eleven toxic labels are enough to find toxic documents and leave all clean ones."""
    import duckdb
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{SF_SMALL}/labels.parquet'").fetchall())
    hit = {r["doc_id"] for r in queries.op6_toxicity(spark, SF_SMALL).collect() if r["predicted"]}
    assert sum(labels.get(i) == 1 for i in hit) >= 5 and not any(labels.get(i) == 0 for i in hit)


def test_held_out_accuracy(spark):
    import duckdb
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{SF_MID}/labels.parquet'").fetchall())
    got = queries.op6_toxicity(spark, SF_MID).collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    rows = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    y = np.array([t for *_, t in rows])
    s, p = np.array([x for x, *_ in rows]), np.array([x for _, x, _ in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    assert auc > 0.75 and (p == y).mean() > 0.9 and p[y == 0].mean() < 0.05


def test_cases(spark, docs_of):
    rows = [(i, "you vile vile creature" if i % 4 == 0 else f"a plain line about tea {i}") for i in range(200)]
    rows += [(900, None), (901, ""), (None, "vile"), (902, "vile vile creature " + "tea " * 20000), (903, "İ vile vile creature")]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0), "x") for i in range(200)] + [(900, 0, 1, "x"), (None, 0, 1, "x"), (901, 1, None, "x"),
                                   (4, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    df = docs_of(rows, True)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _ in rows[:200] if i % 4} <= left and not {0, 4, 8, 196, 902, 903} & left and {900, 901} <= left
    out = toxicity.score(docs_of(rows), toxicity.fit(df, labels)).where("doc_id = 902").first()
    assert out["_passages"][0]["start"] == 0 and out["_passages"][0]["end"] == len("vile vile creature")
    assert toxicity.keep_clean(df, labels.limit(0)).count() == len(rows)
    assert toxicity.keep_clean(df.limit(0), labels).count() == 0
    one_word = toxicity.fit(docs_of([(0, "a"), (1, "a")]), labels.where("doc_id in (0, 1)"))  # a vocabulary of one word tells nothing
    assert not one_word.scores
