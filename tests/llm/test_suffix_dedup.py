"""op11 against the definition: every 50-byte string looked up in a dictionary of smallest documents."""

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tillroll.llm import queries
from tillroll.llm import suffix_dedup as sd


def brute(rows, n):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for k in range(len(t) - n + 1 if i is not None else 0):
            s = t[k:k + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - n + 1 if i is not None else 0):
            if first[t[k:k + n]] < i:
                gone[k:k + n] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


def passages(seed, n_docs, words=("alpha", "beta", "gamma", "delta", "ß", "漢字", "x")):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(6)]
    rows = []
    for i in range(n_docs):
        own = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(3)]
        rows.append((i * 3 % 41, "\n".join([own[0], rng.choice(shared), own[1], rng.choice(shared), own[2]])))
    return rows


@pytest.mark.parametrize("shard_bytes", [100, 700, 1 << 20])
def test_shards_of_any_size(spark, docs_of, shard_bytes):
    """Small shards cut documents into pieces; repeated ids, copies and a very common passage among them."""
    rows = passages(1, 60) + [(100, "z" * 400), (99, "z" * 130), (98, None), (97, ""), (None, "z" * 200), (7, "same"), (7, "same"),
                              (200, "q" * 49), (201, "q" * 50), (202, "q" * 50)]
    got = result(sd.dedup(docs_of(rows, clash=True), shard_bytes=shard_bytes))
    assert got == brute(rows, 50)


def test_other_length_and_spans(spark, docs_of):
    rows = passages(2, 30)
    df = sd.removed(docs_of(rows), length=9, shard_bytes=500)
    assert result(df) == brute(rows, 9)
    texts = {(i, len(t.encode())): t.encode() for i, t in rows}
    for r in df.collect():
        t, at, kept = texts[r["doc_id"], r["n_bytes"]], 0, b""
        for b, e in zip(r["spans"][::2], r["spans"][1::2]):
            kept, at = kept + t[at:b], e
        assert hashlib.sha256(kept + t[at:]).hexdigest() == r["kept_sha256"]


def test_empty_table(spark, docs_of):
    assert sd.dedup(docs_of([])).collect() == []


def test_whole_small_table(spark, small):
    got = result(queries.op11_suffix_dedup(spark, SF_SMALL))
    assert got == brute([(i, t) for i, t in small("documents", "doc_id, text")], 50)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 70))
def test_suffix_array_and_prefixes(text, depth):
    text += b"\xff"  # the end mark of a compact text
    t = np.frombuffer(text, np.uint8)
    sa, starts = sd.suffix_array(t, depth)
    reach = 5
    while reach < depth:
        reach *= 2
    want = sorted(range(len(t)), key=lambda i: (text[i:i + reach], i))
    assert [text[i:i + reach] for i in sa] == [text[i:i + reach] for i in want]
    lcp = sd.common_prefixes(t, sa, starts, depth)
    for k in range(1, len(t)):
        a, b, n = text[sa[k - 1]:], text[sa[k]:], 0
        while n < min(len(a), len(b), depth) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), max_size=20), min_size=1, max_size=7))
def test_merge_keeps_the_range_of_documents(runs):
    arrays = [(np.array([k for k, _ in r], np.uint64), np.array([d for _, d in r], np.int64)) for r in runs]
    least, most = {}, {}
    for r in runs:
        for k, d in r:
            least[k], most[k] = min(d, least.get(k, d)), max(d, most.get(k, d))
    keys, low, high = sd.merge_runs(arrays)
    assert keys.tolist() == sorted(least)
    assert low.tolist() == [least[k] for k in sorted(least)] and high.tolist() == [most[k] for k in sorted(most)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), max_size=20), min_size=1, max_size=7), st.sampled_from([np.uint32, np.uint64]))
def test_merge_tells_where_each_key_stands(runs, kind):
    arrays = [(np.array([k for k, _ in r], kind), np.array([d for _, d in r], np.int64)) for r in runs]
    keys, low, high, own = sd.merge_runs(arrays, return_inverse=True)
    docs = {}
    for k, d in sum(runs, []):
        docs.setdefault(k, []).append(d)
    assert [(int(keys[p]), low[p], high[p]) for p in own] == [(k, min(docs[k]), max(docs[k])) for k, _ in sum(runs, [])]


def test_merging_costs_no_more_than_a_few_sorts():
    """As many runs as the check's larger table sends to one group: searches and inserts two by two, and a search for each key, took 7.6 sorts."""
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 500_000).astype(np.uint64)
    runs = [(rng.choice(pool, 2000), np.sort(rng.integers(0, 250_000, 2000))) for _ in range(464)]
    keys, docs = (np.concatenate(x) for x in zip(*runs))

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    one = seconds(lambda: np.argsort(keys, kind="stable"))
    assert seconds(lambda: sd.merge_runs(runs, return_inverse=True)) < 5 * one
    _, low, _, own = sd.merge_runs(runs, return_inverse=True)
    least = dict(zip(keys[order := np.lexsort((-docs, keys))].tolist(), docs[order].tolist()))
    assert low[own].tolist() == [least[k] for k in keys.tolist()]


def test_hashes_follow_the_bytes():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 4, 200_000).astype(np.uint8)
    for n in (1, 2, 7, 24, 50):
        h = sd.gram_hashes(t, n, 1)
        assert len(h) == len(t) - n + 1
        for i in (0, 65_530, 65_536, len(h) - 1):
            assert h[i] == sd.gram_hashes(t[i:i + n], n, 1)[0]
    least = sd._least(sd.gram_hashes(t, 24, 0), 27)
    h = sd.gram_hashes(t, 24, 0)
    assert all(least[i] == h[i:i + 27].min() for i in range(0, len(least), 997))
