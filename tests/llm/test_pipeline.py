import corpus_pipeline
from tillroll.llm import line_dedup, near_dup, tiling, toxicity
from tillroll.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_near_dup import brute as brute_classes
from tests.llm.test_line_dedup import key
from tests.llm.test_tiling import brute as brute_tiling


def test_stages_in_order_against_brute_force(spark):
    """Each stage on its own input: what it must drop goes, everything else stays as it was."""
    from collections import Counter
    docs = table(spark, SF_SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(spark.createDataFrame(out.collect(), out.schema) if (out := stage(spark, inputs[-1], SF_SMALL)) else None)
    rows = [sorted(map(tuple, df.collect())) for df in inputs]
    assert all(df.columns == docs.columns for df in inputs[:5])
    model = toxicity.fit(docs, table(spark, SF_SMALL, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("_toxicity < 0.5").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in clean] and 0.8 < len(rows[1]) / len(rows[0]) < 1
    found = Counter(k for r in rows[1] for k in {key(x) for x in r[1].split("\n")} if k)
    kept = ["\n".join(x for x in r[1].split("\n") if found[key(x)] < line_dedup.MIN_DOCS) for r in rows[1]]
    assert rows[2] == [(r[0], t, *r[2:4], len(t) if t != r[1] else r[4]) for r, t in zip(rows[1], kept)]
    classes, _ = brute_classes([r[:2] for r in rows[2]])
    assert rows[3] == [r for r in rows[2] if classes[r[0]] == r[0]]
    bench = [tuple(r) for r in table(spark, SF_SMALL, "benchmark").collect()]
    gone = {r[0] for r in rows[3]} - {r[0] for r in rows[4]}
    assert {r[0] for r in rows[3] if any(b in r[1] for _, b in bench)} <= gone
    for i, t in [r[:2] for r in rows[3] if r[0] in gone]:
        assert any(m for m in [tiling.matches(t, tiling.Seeds(bench, tiling.TILE), tiling.COVERAGE)])
    assert {r[0] for r in rows[5]} == {r[0] for r in rows[4]}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_empty_and_odd_documents_pass_every_stage(spark, docs_of):
    for df in (docs_of([]), docs_of([(1, None), (None, ""), (2, "a"), (2, "a"), (3, "x\n" * 3000)], True)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF_SMALL)
            df.collect()


def test_near_duplicates_keep_one(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    kept = near_dup.keep_one(docs_of([(5, text), (3, text.upper()), (9, text + " more"), (1, "another text of its own")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_reordered_leak_goes(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(20))
    w = item.split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, " ".join(w[10:] + ["and"] + w[:10])), (2, "nothing of it")]
    assert [r["doc_id"] for r in tiling.decontaminate(docs_of(docs), bench).collect()] == [2]
    assert [bool(x) for x in brute_tiling(docs, [(1, item)]).values()] == [True, False]
