import numpy as np

from tillroll.llm import queries, tiling
from tillroll.llm.common import hash_words, words
from tests.conftest import SF_SMALL


def brute_tiles(doc, item, length):
    """Greedy string tiling as defined, word by word."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                       and not used_d[i + n] and not used_i[j + n]):
                    n += 1
                if n >= length and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        used_d[i:i + n] = used_i[j:j + n] = [True] * n
        tiles.append(n)


def brute(rows, items, tile=5, coverage=0.5):
    out = {}
    for i, t in rows:
        found = []
        for item_id, b in items:
            w = words(b)
            if w:
                tiles = brute_tiles(words(t), w, min(tile, len(w)))
                if sum(tiles) >= coverage * len(w):
                    found.append((item_id, sum(tiles) / len(w)))
        out[i] = sorted(found)
    return out


def test_whole_table_finds_every_contained_item(spark, small):
    docs, items = small("documents", "doc_id, text"), small("benchmark", "item_id, text")
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    grams = {b: {tuple(words(t)[k:k + 5]) for k in range(len(words(t)) - 4)} for b, t in items}
    for i, t in docs:
        w = words(t)
        mine = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        near = [(b, x) for b, x in items if mine & grams[b]]
        # the cubic definition only where a window is shared: no other pair has a tile
        want = brute([(i, t)], near)[i] if len(w) < 400 else [(b, None) for b, x in near if x in t]
        ids = [b for b, _ in want]
        assert got[i]["item_ids"] == ids if len(w) < 400 else set(ids) <= set(got[i]["item_ids"])


def test_cases(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    w = item.split()
    rows = [(1, item.upper() + "!"), (2, " ".join(w[10:] + ["x"] + w[:10])), (3, " ".join(w[:9])), (4, "w1 w2 w3 w4"), (5, None),
            (6, ""), (7, "short one here"), (None, item), (8, " ".join(w[:5] + ["y"] + w[:5] + ["y"] + w[:6])),
            (9, "pad " * 5000 + item), (1, "clean"), (10, " ".join(w[:5] + w[8:13] + w[15:]))]
    items = [(1, item), (2, None), (3, ""), (4, "short one"), (1, item), (None, "w0 w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(rows, True)
    kept = tiling.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    got = {r["doc_id"]: r for r in tiling.report(docs_of([r for r in rows if r[1] != "clean"]), bench).collect()}
    assert got[2]["item_ids"] == [1, 1, None] and got[2]["tiles"] >= 2 and got[7]["item_ids"] == [4]
    assert got[9]["coverage"] == 1.0 and got[10]["contaminated"] and got[3]["item_ids"] == [None]
    assert tiling.decontaminate(df, bench.limit(0)).count() == len(rows)
    assert tiling.report(df.limit(0), bench).count() == 0


def test_slices_give_the_same(spark, docs_of, small, monkeypatch):
    docs, bench = docs_of(small("documents", "doc_id, text")), spark.createDataFrame(small("benchmark", "item_id, text"), "item_id long, text string")
    one = sorted(map(tuple, tiling.report(docs, bench).collect()))
    monkeypatch.setattr(tiling, "SLICE_SEEDS", 200)
    assert sorted(map(tuple, tiling.report(docs, bench).collect())) == one and sum(r[1] for r in one) > 0


def test_tiles_against_definition():
    rng = np.random.default_rng(7)
    for _ in range(150):
        doc, item = [[f"w{x}" for x in rng.integers(0, 4, n)] for n in (40, 18)]
        seeds = tiling.Seeds([(0, " ".join(item))], 3)
        pairs = list(seeds.pairs(hash_words(doc)))
        got = tiling.tile_lengths(18, 3, pairs[0][2], pairs[0][3]) if pairs else []
        assert got == brute_tiles(doc, item, 3)
