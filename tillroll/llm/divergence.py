"""Source divergence audit over an index built in one pass.

Per language every source is compared with every other, and with the language as a whole, by
the smoothed frequencies of its terms.

1. Blocks.  A task reads its documents once and counts, in memory, occurrences per (lang, source, term)
   and documents per (lang, term).  When ``block_terms`` entries are held, the block is
   spilled as a run: per language and hash shard its terms in ascending order with their postings, packed and compressed.
2. Merging.  The runs of a language's shard are heap-merged by term
   into frequencies.  At most ``fan_in`` runs are merged at a time; more take further passes.
   Terms below ``min_docs`` documents fall away in the last.
3. Corrections.  Over all V kept terms, the value of a pair of sources is what it would be if neither held any
   term; plus, per source, what its own terms change (from the histogram of its counts);
   plus a correction for each term that both hold.  These come from one pass over the postings, summed up per pair in each task
   before they are shuffled, so neither zeros nor pairs of postings are ever rows.

A run holds a term once however often it occurs, so the most frequent word
is pre-aggregated before its shuffle; shards follow the size of the texts. All arithmetic is in integers: frequencies are parts of 10^9, divided as
decimals of 38 digits.

Defined cases: null text, lang or source count as ''; each row is a document (a repeated row counts
again); a term never crosses a separator, only A-Z are lower-cased; a
text is counted in slices, so its length is bounded by a row alone; a language without kept terms has pair rows of value 0 and no term rows; other columns, ids among them, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

MIN_DOCS, TOP_TERMS, UNIT = 10, 10, 1_000_000_000
BLOCK_TERMS, FAN_IN, SHARD_BYTES, BUFFER, SLICE = 800_000, 4096, 16 << 20, 1 << 20, 1 << 20
RUNS = "run long, lang string, shard int, n_terms long, n_postings long, n_bytes long, sources array<string>, terms binary, numbers binary"
POSTINGS = "lang string, term string, source string, n long, own long, first boolean"
_PAIRS = "lang string, a string, b string, fix long"
#: Separators become blanks, A-Z become a-z; bytes from 0x80 on belong to characters beyond ASCII, all of them letters here.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice; cuts fall on separators."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


class Run(NamedTuple):
    """Terms ascending; documents and postings per term; of each posting the source's number and its count."""

    terms: list[bytes]
    docs: np.ndarray
    sizes: np.ndarray
    sources: list[str]
    source: np.ndarray
    counts: np.ndarray

    def packed(self) -> dict:
        terms = b"\n".join(self.terms)  # a term holds no line break
        numbers = np.concatenate([self.docs, self.sizes, self.source, self.counts]).astype(np.int64)
        return {"n_terms": len(self.terms), "n_postings": len(self.counts), "n_bytes": len(terms), "sources": self.sources,
                "terms": pa.compress(terms, "zstd", asbytes=True), "numbers": pa.compress(numbers.tobytes(), "zstd", asbytes=True)}

    @staticmethod
    def unpacked(row: dict) -> Run:
        n, m = row["n_terms"], row["n_postings"]
        terms = pa.decompress(row["terms"], row["n_bytes"], codec="zstd", asbytes=True).split(b"\n")
        x = np.frombuffer(pa.decompress(row["numbers"], 8 * (2 * n + 2 * m), codec="zstd", asbytes=True), np.int64)
        return Run(terms, x[:n], x[n:2 * n], row["sources"], x[2 * n:2 * n + m], x[2 * n + m:])

    def picked(self, at: np.ndarray) -> Run:
        """The terms at the ascending places ``at``."""
        ends = np.cumsum(self.sizes)
        sizes = self.sizes[at]
        posting = np.repeat(ends[at] - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Run([self.terms[i] for i in at.tolist()], self.docs[at], sizes, self.sources, self.source[posting], self.counts[posting])


class Block:
    """Postings in memory: occurrences per (lang, source) and term, documents per lang and term."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}
        self.held = 0

    def _add(self, counter: Counter, terms: list[bytes] | set[bytes]) -> None:
        before = len(counter)
        counter.update(terms)
        self.held += len(counter) - before

    def add_terms(self, lang: str, source: str, terms: list[bytes]) -> None:
        self._add(self.counts.setdefault(lang, {}).setdefault(source, Counter()), terms)

    def add_document(self, lang: str, terms: set[bytes]) -> None:
        self._add(self.docs.setdefault(lang, Counter()), terms)

    def runs(self) -> Iterator[tuple[str, Run]]:
        """One term-sorted run per language with terms."""
        for lang in {**self.docs, **self.counts}:
            docs, by_source = self.docs.get(lang, Counter()), self.counts.get(lang, {})
            # A document cut by a spill counts its terms in one block and itself in the next.
            terms = sorted(set(docs).union(*by_source.values()))
            if not terms:
                continue
            place = {t: i for i, t in enumerate(terms)}
            sources = sorted(by_source)
            at = [np.fromiter(map(place.__getitem__, by_source[s]), np.int64, len(by_source[s])) for s in sources]
            term = np.concatenate([*at, np.empty(0, np.int64)])
            source = np.repeat(np.arange(len(sources)), [len(a) for a in at])
            counts = np.concatenate([*(np.fromiter(by_source[s].values(), np.int64, len(by_source[s])) for s in sources), np.empty(0, np.int64)])
            order = np.argsort(term, kind="stable")
            yield lang, Run(terms, np.fromiter((docs[t] for t in terms), np.int64, len(terms)),
                            np.bincount(term, minlength=len(terms)), sources, source[order], counts[order])


_RUN_KINDS = {"run": pa.int64(), "lang": pa.string(), "shard": pa.int32(), "n_terms": pa.int64(), "n_postings": pa.int64(),
              "n_bytes": pa.int64(), "sources": pa.list_(pa.string()), "terms": pa.binary(), "numbers": pa.binary()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in _RUN_KINDS.items()], list(_RUN_KINDS))


def _as_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def build_runs(docs: DataFrame, shards: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Term-sorted runs of all blocks, cut into hash shards (``RUNS``)."""
    def spill(block: Block, run: int) -> Iterator[pa.RecordBatch]:
        for lang, own in block.runs():
            shard = np.fromiter(map(zlib.crc32, own.terms), np.int64, len(own.terms)) % shards
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            yield _batch([{"run": run, "lang": lang, "shard": k} | own.picked(order[cuts[k]:cuts[k + 1]]).packed()
                          for k in range(shards) if cuts[k] < cuts[k + 1]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_runs, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                distinct: set[bytes] = set()
                for terms in slices(text.as_py()):
                    block.add_terms(lang, source, terms)
                    distinct.update(terms)
                    if block.held >= block_terms:
                        yield from spill(block, (part << 32) + n_runs)
                        n_runs, block = n_runs + 1, Block()
                block.add_document(lang, distinct)
        yield from spill(block, (part << 32) + n_runs)

    own = docs.select(_as_empty("lang"), _as_empty("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(read, RUNS)


def merge(runs: list[Run], least: int = 0) -> Run:
    """One run of many: a heap merge of their terms, the documents and postings of a term added up.

    Terms in fewer than ``least`` documents are left out."""
    terms: list[bytes] = []
    number: list[list[int]] = [[] for _ in runs]
    last = None
    for term, i in heapq.merge(*(zip(r.terms, repeat(i)) for i, r in enumerate(runs))):
        if term != last:
            terms.append(term)
            last = term
        number[i].append(len(terms) - 1)
    at = [np.array(n, np.int64) for n in number]
    docs = np.zeros(len(terms), np.int64)
    for n, r in zip(at, runs):
        docs[n] += r.docs  # a run holds a term once
    sources = sorted({s for r in runs for s in r.sources})
    place = {s: i for i, s in enumerate(sources)}
    code = [np.array([place[s] for s in r.sources], np.int64)[r.source] if r.sources else r.source for r in runs]
    key = np.concatenate([np.repeat(n, r.sizes) * max(len(sources), 1) + c for n, r, c in zip(at, runs, code)])
    counts = np.concatenate([r.counts for r in runs])
    kept = docs >= least
    own = kept[key // max(len(sources), 1)]
    key, counts = key[own], counts[own]
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.add.reduceat(counts, first) if len(first) else counts
    term, source = key[first] // max(len(sources), 1), key[first] % max(len(sources), 1)
    return Run([t for t, k in zip(terms, kept.tolist()) if k], docs[kept], np.bincount(term, minlength=len(terms))[kept], sources, source, counts)


def _posting_table(lang: str, run: Run) -> pa.Table:
    """Rows of ``POSTINGS``: ``own`` is the term's count in its language, ``first`` marks one row of each term."""
    term = np.repeat(np.arange(len(run.terms)), run.sizes)
    total = np.zeros(len(run.terms), np.int64)
    np.add.at(total, term, run.counts)
    return pa.table({
        "lang": pa.array([lang] * len(term), pa.string()),
        "term": pa.array(run.terms, pa.binary()).cast(pa.string()).take(pa.array(term)),
        "source": pa.array(run.sources, pa.string()).take(pa.array(run.source)), "n": pa.array(run.counts, pa.int64()),
        "own": pa.array(total[term], pa.int64()), "first": pa.array(np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else [], pa.bool_())})


def merge_runs(runs: DataFrame, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """The postings (``POSTINGS``) of the terms in at least ``min_docs`` documents of their language."""
    table = stored(runs, "runs")
    while True:
        groups = math.ceil((table.agg(F.count_distinct("run")).first()[0] or 1) / fan_in)
        if groups <= 1:
            return stored(table.groupBy("lang", "shard").applyInArrow(
                lambda key, t: _posting_table(key[0].as_py(), merge([Run.unpacked(r) for r in t.to_pylist()], min_docs)), POSTINGS), "postings")

        def some(key: tuple, t: pa.Table) -> pa.Table:
            lang, shard, group = (k.as_py() for k in key)
            return pa.Table.from_batches([_batch([{"run": group, "lang": lang, "shard": shard} | merge(
                [Run.unpacked(r) for r in t.to_pylist()]).packed()])])

        dealt = table.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        table = stored(dealt.groupBy("lang", "shard", "group").applyInArrow(some, RUNS), "runs")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), in whole numbers of any size a count can have."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)"))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); parts of 10^9 keep the square below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_fixes(postings: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """lang, a, b, fix: over the terms that both sources hold, what their sharing changes; a < b in one task's numbering.

    ``postings`` holds lang, term, source, p and zero (the source's p for a term it lacks), with the rows of a
    (lang, term) together in one partition.  A task adds up at most ``buffer`` pair values before it writes sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        codes: list[np.ndarray] = []
        fixes: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
            out = np.zeros(len(pairs), np.int64)
            np.add.at(out, at, np.concatenate(fixes))
            return pairs, out

        def write() -> pa.RecordBatch:
            by_code = list(names)
            pairs, out = summed()
            left, right = [by_code[c] for c in pairs >> 32], [by_code[c] for c in pairs & 0xFFFFFFFF]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in left], pa.string()), pa.array([x[1] for x in left], pa.string()),
                 pa.array([x[1] for x in right], pa.string()), pa.array(out, pa.int64())], ["lang", "a", "b", "fix"])

        for term, code, p, zero in _whole_terms(batches, names):
            order = np.lexsort((code, term))
            term, code, p, zero = term[order], code[order], p[order], zero[order]
            step = 1
            while step < len(term):  # each posting with the one ``step`` places on, where that is of its term
                at = np.flatnonzero(term[step:] == term[:-step])
                if not len(at):
                    break
                a, b, a0, b0 = p[at], p[at + step], zero[at], zero[at + step]
                codes.append((code[at] << 32) | code[at + step])
                fixes.append(_gaps(a, b) - _gaps(a, b0) - _gaps(a0, b) + _gaps(a0, b0))
                size += len(at)
                step += 1
                if size >= buffer:
                    pairs, out = summed()
                    if len(pairs) > buffer // 2:  # many different pairs: written, not kept
                        yield write()
                        codes, fixes, size = [], [], 0
                    else:
                        codes, fixes, size = [pairs], [out], len(pairs)
        if codes:
            yield write()

    return postings.select("lang", "term", "source", "p", "zero").mapInArrow(run, _PAIRS)


def _whole_terms(batches: Iterator[pa.RecordBatch], names: dict[tuple[str, str], int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Term number, source number, p and zero of the postings, batch by batch; a batch's last term waits for the next one."""
    held = [np.empty(0, np.int64) for _ in range(4)]
    last, number = None, 0
    for b in batches:
        term, code = [], []
        for lang, t, source in zip(*(b.column(c).to_pylist() for c in ("lang", "term", "source"))):
            if (lang, t) != last:
                last, number = (lang, t), number + 1
            term.append(number)
            code.append(names.setdefault((lang, source), len(names)))
        new = [np.array(term, np.int64), np.array(code, np.int64), *(np.asarray(b.column(c), np.int64) for c in ("p", "zero"))]
        held = [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(held[0], number))
        yield tuple(x[:cut] for x in held)
        held = [x[cut:] for x in held]
    yield tuple(held)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
          fan_in: int = FAN_IN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    postings = merge_runs(build_runs(docs, max(math.ceil(size / shard_bytes), 1), block_terms), min_docs, fan_in)
    groups = docs.select(_as_empty("lang"), _as_empty("source")).distinct()
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    langs = own.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.sum("total").alias("all"))
    zero = F.lit(0).cast("long")
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"), F.coalesce("all", zero).alias("all"))
    known = stored(totals.withColumn("zero", F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept")))), "source-totals")
    # Postings with their shares: read by the histograms, the corrections and the ranks of terms.
    shares = stored(postings.join(known, ["lang", "source"]).select(
        "lang", "term", "source", "own", "kept", "all", "zero", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")), "shares")
    return _pairs(known, shares).unionByName(_terms(shares, top_terms))


def _pairs(known: DataFrame, shares: DataFrame) -> DataFrame:
    """All ordered pairs of a language's sources (the report itself), with their divergence."""
    fixes = pair_fixes(shares.repartition("lang", "term").sortWithinPartitions("lang", "term"))
    fix = fixes.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "fix").groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix"))
    a = known.select("lang", F.col("source").alias("a"), F.col("zero").alias("a0"), "kept")
    b = known.select("lang", F.col("source").alias("b"), F.col("zero").alias("b0"))
    pairs = a.join(b, "lang").where("a < b")
    # A source's own terms against a source that lacks them: one row per different count, not per term.
    counts = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    own = (counts.withColumnRenamed("source", "x").join(known.select("lang", F.col("source").alias("y"), F.col("zero").alias("y0")), "lang").where("x <> y")
           .groupBy("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
           .agg(F.sum(F.col("terms") * (_gap(F.col("p"), F.col("y0")) - _gap(F.col("zero"), F.col("y0")))).alias("own")))
    base = F.when(F.col("kept") > 0, F.col("kept") * _gap(F.col("a0"), F.col("b0")))
    value = sum((F.coalesce(c, F.lit(0)) for c in (F.col("own"), F.col("fix"))), F.coalesce(base, F.lit(0)))
    valued = pairs.join(own, ["lang", "a", "b"], "left").join(fix, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value"))
    both = valued.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", rank)


def _terms(shares: DataFrame, top: int) -> DataFrame:
    """Per source the terms that it uses most above its language."""
    over = shares.withColumn("q", _share(F.col("own"), F.col("all"), F.col("kept"))).where("p > q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")).withColumn(
        "rank", rank).where(F.col("rank") <= top)


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda n, total: f"(1 + ({UNIT}::hugeint * ({n} + 2)) // ({total} + 2 * v))"
    gap = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::hugeint AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {min_docs}),
vs AS (SELECT lang, count(*)::hugeint AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::hugeint AS total FROM g LEFT JOIN (c SEMI JOIN k USING (lang, term)) c
       ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
ln AS (SELECT lang, sum(total)::hugeint AS total FROM gn GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "gn.total")} AS p
      FROM g JOIN k USING (lang) JOIN vs USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, {share("n", "ln.total")} AS q FROM (SELECT lang, term, sum(n)::hugeint AS n FROM p GROUP BY ALL)
      JOIN ln USING (lang) JOIN vs USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum({gap("a.p", "b.p")}) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::bigint AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {gap("p.p", "q")}::bigint AS value
      FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank
      FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {top}"""
