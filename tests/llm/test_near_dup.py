from collections import Counter, defaultdict

import numpy as np

from tillroll.llm import near_dup, queries
from tillroll.llm.common import hash_words, shingle_set, words
from tests.conftest import SF_MID


def brute(rows, threshold=0.8):
    """Classes by exact similarity of all pairs that share a shingle: doc_id -> smallest id, and the pairs."""
    sets = [(i, set(shingle_set(hash_words(words(t))).tolist()), " ".join(words(t))) for i, t in rows]
    inv, parent = defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s, _) in enumerate(sets):
        for h in s:
            inv[h].append(k)
    common = Counter()
    for ks in inv.values():
        common.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1:])
    pairs = set()
    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a][1]) + len(sets[b][1]) - n) - 1e-9:
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
            pairs.add((sets[a][0], sets[b][0]))
    return {i: find(i) for i, _ in rows}, pairs


def test_classes_are_those_of_all_pairs(spark):
    import duckdb
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_MID}/documents.parquet'").fetchall()
    want, _ = brute(rows)
    got = queries.op2_jaccard_join(spark, SF_MID).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got} == want


def test_large_groups_and_chains(spark, docs_of):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]

    def edit(ws, n):
        ws = list(ws)
        for at in rng.integers(0, len(ws), n):
            ws[at] = f"n{rng.integers(0, 10 ** 9)}"
        return ws

    rows = [(i, " ".join(base)) for i in range(100)] + [(100 + i, " ".join(edit(base, 4))) for i in range(300)]
    chain, k = base[::-1], 1000
    for _ in range(25):  # each is near the one before it, the ends are not
        rows.append((k, " ".join(chain)))
        chain, k = edit(chain, 5), k + 1
    rows += [(2000 + i, " ".join(f"u{x}" for x in rng.integers(0, 5000, 200))) for i in range(100)]
    want, pairs = brute(rows)
    got = near_dup.classes(docs_of(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    linked = {x for p in pairs for x in p}
    texts = dict(rows)
    for r in got:
        alone = not any(texts[a] != texts[b] for a, b in pairs if r["doc_id"] in (a, b)) if r["doc_id"] >= 1000 else False
        assert (r["n_links"] > 0) == (r["doc_id"] in linked and not alone)
    assert sum(r["n_links"] for r in got if 100 <= r["doc_id"] < 400) < 300 * 40  # far from all pairs


def test_links_are_those_of_all_pairs(spark, docs_of):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base)), (500, " ".join(base).upper())]
    for i in range(1, 150):
        ws = list(base)
        for at in rng.integers(0, len(ws), int(rng.integers(1, 6))):
            ws[at] = f"n{rng.integers(0, 10 ** 9)}"
        rows.append((i, " ".join(ws)))
    _, pairs = brute([r for r in rows if r[0] != 500])
    want = Counter(x for p in pairs for x in p)
    for more in ({}, {"block_rows": 20}, {"block_shingles": 9000}):
        got = {r["doc_id"]: r["n_links"] for r in near_dup.classes(docs_of(rows), **more).collect()}
        assert got.pop(500) == got[0] and got == {i: want[i] for i in range(150)}


def test_members_of_a_bucket_meet_without_a_hub(spark, docs_of):
    """Pairs just above the threshold among documents of one template, each below it to all others."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(300):
        ws = list(base)
        for at in rng.choice(80, 6, replace=False):
            ws[at * 5] = f"n{rng.integers(0, 10 ** 9)}"
        rows.append((i, " ".join(ws)))
        if i % 3 == 0:
            twin = list(ws)
            for at in rng.choice(80, 8, replace=False):
                twin[at * 5] = f"n{rng.integers(0, 10 ** 9)}"
            rows.append((1000 + i, " ".join(twin)))
    want, _ = brute(rows)
    for more in ({}, {"block_rows": 40, "block_shingles": 30_000}):
        got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs_of(rows), **more).collect()}
        assert got == want


def test_cases(spark, docs_of):
    rows = [(1, "one two"), (2, "One  TWO!"), (3, "one two three"), (4, None), (5, ""), (6, "..."), (None, "one two"), (None, "alone here"),
            (7, "a b c d e f"), (7, "a b c d e f"), (7, "other text of the same id"), (8, "x " * 30000)]
    df = docs_of(rows, True)
    got = sorted((tuple(r) for r in near_dup.classes(df).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (None, 1, 0), (None, None, 0),
                          (7, 7, 0), (7, 7, 0), (7, 7, 0), (8, 8, 0)], key=str)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None, None]))
    assert near_dup.classes(df.limit(0)).count() == 0 and near_dup.keep_one(df.limit(0)).count() == 0


def test_depth_meets_the_recall():
    d = near_dup.depth()
    assert 1 - (1 - 0.8 ** d) ** near_dup.TREES >= near_dup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_dup.TREES
