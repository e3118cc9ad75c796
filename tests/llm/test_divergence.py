"""op13 against its definition, term by term and source by source."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, kept int, p long"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def share(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) * (p - q) // (p + q)

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["The", "the", "straße", "STRASSE", "É", "é", "漢字", "a", "b", "Zoo", "x1y", "don't", " ", "z" * 300]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot", "hot", "s1", "s2", "ß", None])
        words = rng.choices(vocab, weights=[9, 7, 5, 5, 4, 4, 3, 3, 2, 2, 2, 1, 1, 1], k=rng.randint(0, 25))
        rows.append((rng.choice([" ", "-", "\n"]).join(words), lang, source))
    return rows + [(None, "en", "none"), ("", "xx", "only"), ("1 2 3", "xx", "digits"), ("rare words", "yy", "s")]


@pytest.mark.parametrize("block,fan,shard", [(300_000, 4096, 1 << 24), (25, 2, 2000)])
def test_any_blocks(spark, block, fan, shard):
    """Few large blocks in one pass, and many small runs merged in several."""
    rows = corpus(4, 260)
    rows += rows[:30]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA).repartition(6)
    assert result(dv.audit(df, block_terms=block, fan_in=fan, shard_bytes=shard)) == brute(rows)


def test_other_bars(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    assert result(dv.audit(df, min_docs=3, top_terms=2)) == brute(rows, 3, 2)


def test_empty_table(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_corrections_with_a_small_buffer(spark):
    """Sums leave a full buffer early and add up to the same."""
    rng = random.Random(6)
    rows = [("l", f"t{t:03}", f"s{s}", rng.randint(2, 10**9), 1 + s) for t in range(200) for s in range(9) if rng.random() < .6]
    df = spark.createDataFrame(rows, "lang string, term string, source string, p long, zero long").repartition(2, "term").sortWithinPartitions("lang", "term")

    def sums(buffer):
        out = dv.pair_fixes(df, buffer).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("fix").alias("f"))
        return sorted(map(tuple, out.collect()))

    assert sums(4) == sums(1 << 20) == sums(60)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZz09 -[`{~\x7f\x80éß漢😀\n"), max_size=60), st.integers(1, 20))
def test_slices_hold_all_terms(text, size):
    got = [t.decode() for s in dv.slices(text.encode(), size) for t in s]
    assert got == terms_of(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from([b"a", b"b", "é".encode(), b"z"]), st.dictionaries(st.sampled_from("pqr"), st.integers(1, 5), min_size=1)), max_size=5))
def test_heap_merge_adds_postings(runs):
    got = {}
    made = []
    for r in runs:
        block = dv.Block()
        for t, c in r.items():
            for source, n in c.items():
                block.add_terms("en", source, [t] * n)
            block.add_document("en", {t})
        made += [dv.Run.unpacked(run.packed()) for _, run in block.runs()]
    out = dv.merge(made) if made else dv.Run([], *[[]] * 5)
    at = 0
    for t, n, size in zip(out.terms, out.docs, out.sizes):
        got[t] = int(n), {out.sources[s]: int(c) for s, c in zip(out.source[at:at + size], out.counts[at:at + size])}
        at += size
    want = {}
    for r in runs:
        for t, c in r.items():
            n, old = want.get(t, (0, Counter()))
            want[t] = n + 1, old + Counter(c)
    assert got == {t: (n, dict(c)) for t, (n, c) in want.items()} and list(got) == sorted(got)
