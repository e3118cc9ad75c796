import hashlib
from collections import Counter

import pytest

from tillroll.llm import line_dedup as L
from tillroll.llm import queries
from tests.conftest import SF_SMALL


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, min_docs):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or found[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark, small):
    got = sorted(map(tuple, queries.op8_line_dedup(spark, SF_SMALL).collect()), key=str)
    assert got == brute(small("documents", "doc_id, text"), 10)


@pytest.mark.parametrize("clash", [False, True])
def test_cases(spark, docs_of, clash):
    rows = [(1, "A b \n x\n\nÉ"), (2, "a B\t\ny"), (2, "a b"), (3, None), (4, ""), (None, " a b\nz"), (None, " a b\nz"),
            (5, "É\né\nÉ"), (6, "É"), (7, "\u00a0a b"), (8, "long " * 5000 + "\nA B")]
    df = docs_of(rows, clash)
    assert sorted(map(tuple, L.digests(df, 3).collect()), key=str) == brute(rows, 3)
    out = L.dedup(df, 3)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[1] == (" x\n", 3) and texts[3] == (None, None) and texts[None] == ("z", 1)
    assert L.digests(df.limit(0)).count() == 0
