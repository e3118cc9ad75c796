"""Checkpoints do not pass on estimates that grow without end: the driver would fill with the digits of one number."""

from pyspark.sql import functions as F

from tillroll.plans.admission import admit_bills
from tillroll.plans.components import components
from tillroll.session import checkpointed

UNKNOWN = (1 << 63) - 1


def _estimate(df) -> int:
    return df._jdf.queryExecution().analyzed().stats().sizeInBytes()


def test_a_loop_of_joins_keeps_its_estimate_small(spark):
    df = spark.range(8).select(F.col("id").alias("k"))
    small = checkpointed(df)
    assert _estimate(small) <= 1000  # an estimate that can be true stays
    for _ in range(12):
        small = checkpointed(small.join(small.select(F.col("k").alias("j")), F.col("k") == F.col("j")).select("k"))
    assert _estimate(small) <= UNKNOWN
    assert sorted(r.k for r in small.collect()) == list(range(8))


def test_components_keep_their_estimate_small(spark):
    edges = spark.range(64).select(F.col("id").alias("x"), (F.col("id") + F.when(F.col("id") % 16 == 15, 0).otherwise(1)).alias("y"))
    found = components(edges, "x", "y")
    assert _estimate(found) <= UNKNOWN
    assert {(r.node, r.component) for r in found.collect()} == {(i, i // 16 * 16) for i in range(64)}


def test_admission_keeps_its_estimate_small(spark, monkeypatch):
    import tillroll.plans.admission as A
    seen = []
    monkeypatch.setattr(A, "checkpointed", lambda df: seen.append(checkpointed(df)) or seen[-1])
    rows = [(b, b * i % 5, 1 + (b + i) % 3) for b in range(40) for i in (1, 2)]
    lines = spark.createDataFrame(rows, "bill_id long, product_id long, quantity int").withColumn(
        "created_at", F.timestamp_add("SECOND", F.col("bill_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    stock = spark.createDataFrame([(p, 12) for p in range(5)], "product_id long, stock int")
    got = {r.bill_id: r.accepted for r in admit_bills(lines, stock, fold_lines=8, chunk_rows=16).collect()}
    left, want = dict.fromkeys(range(5), 12), {}
    for b in range(40):
        need = {}
        for x, p, q in rows:
            if x == b:
                need[p] = need.get(p, 0) + q
        want[b] = all(left[p] >= q for p, q in need.items())
        for p, q in need.items() if want[b] else ():
            left[p] -= q
    assert got == want
    assert max(map(_estimate, seen)) <= UNKNOWN
