"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into seeds, hashed windows of ``tile`` words (a shorter
item has one seed, its whole word sequence).  A document's own rolling
(Karp-Rabin) window hashes are joined with the seeds inside the task that read
the document.  For an item whose shared seeds could cover enough of it,
greedy string tiling marks the longest match of words not yet marked, again and
again; the marked share of the item's words is its coverage.  Tiles may come in
any order, so reordered passages count.  A document is contaminated if an
item's coverage reaches ``coverage``.

The seeds travel as broadcast slices of at most ``SLICE_SEEDS`` seeds (12 bytes
each plus the items' words, so a few tens of MB); a larger benchmark takes more
passes over the documents, one per slice.  Documents are never shuffled.

Defined cases: null or empty texts and items match nothing; each row is a
document; repeated items are each reported; a null ``item_id`` counts towards
contamination and is reported as null; an empty benchmark leaves
every document clean; ``decontaminate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tillroll.llm.common import fresh, hash_words, windows, words

TILE, COVERAGE, SLICE_SEEDS = 5, 0.5, 1_000_000
MATCHES = ArrayType(StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType()),
                                StructField("tiles", LongType()), StructField("longest", LongType())]))


class Seeds:
    """The seeds of some items: per window length, sorted hashes with (item, place) beside them."""

    def __init__(self, items: list[tuple[int | None, str | None]], tile: int):
        self.tile = tile
        self.items = [(i, h) for i, t in items if len(h := hash_words(words(t)))]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, (_, h) in enumerate(self.items):
            w = windows(h, min(tile, len(h)))
            found.setdefault(min(tile, len(h)), []).append((w, np.full(len(w), n, np.int32), np.arange(len(w), dtype=np.int32)))
        self.by_length = {}
        for length, rows in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(h, kind="stable")
            self.by_length[length] = h[order], item[order], place[order]

    def pairs(self, doc: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, window length, document places, item places) of the shared seeds, per item."""
        for length, (h, item, place) in self.by_length.items():
            w = windows(doc, length)
            at = np.minimum(np.searchsorted(h, w), len(h) - 1)
            where = np.flatnonzero(h[at] == w)
            if not len(where):
                continue
            lo, hi = at[where], np.searchsorted(h, w[where], "right")
            n = hi - lo
            flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            d, i, p = np.repeat(where, n), item[flat], place[flat]
            order = np.argsort(i, kind="stable")
            d, i, p = d[order], i[order], p[order]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for dd, ii, pp in zip(np.split(d, cuts), np.split(i, cuts), np.split(p, cuts)):
                yield int(ii[0]), length, dd, pp


def tile_lengths(n_item: int, length: int, d: np.ndarray, p: np.ndarray) -> list[int]:
    """Greedy string tiling over the seed pairs (document place, item place) of one item: the tiles' lengths.

    Runs of pairs along a diagonal are common word sequences; the longest run of
    pairs that touch no marked word becomes a tile (ties: first in the document,
    then in the item), until no pair is free.
    """
    order = np.lexsort((d, d - p))
    d, p = d[order].astype(np.int64), p[order].astype(np.int64)
    free_item = np.ones(n_item, bool)
    tiles = []
    while len(d):
        starts = np.concatenate([[0], np.flatnonzero((np.diff(d) != 1) | (np.diff(p) != 1)) + 1])
        runs = np.diff(np.concatenate([starts, [len(d)]]))
        best = starts[runs == runs.max()]
        s = best[np.lexsort((p[best], d[best]))[0]]
        size = int(runs.max()) + length - 1
        d0, p0 = d[s], p[s]
        tiles.append(size)
        free_item[p0:p0 + size] = False
        keep = ((p + length <= p0) | (p >= p0 + size)) & ((d + length <= d0) | (d >= d0 + size))
        d, p = d[keep], p[keep]
    return tiles


def matches(text: str, seeds: Seeds, coverage: float) -> list[dict]:
    """The items whose tiled share in ``text`` reaches ``coverage``, by item_id."""
    doc = hash_words(words(text))
    found = []
    for n, length, d, p in seeds.pairs(doc):
        item_id, h = seeds.items[n]
        if len(np.unique(p)) * length < coverage * len(h):
            continue  # a tiled word lies in a shared seed: this bounds the coverage
        tiles = tile_lengths(len(h), length, d, p)
        if sum(tiles) >= coverage * len(h):
            found.append({"item_id": item_id, "coverage": sum(tiles) / len(h), "tiles": len(tiles), "longest": max(tiles)})
    return sorted(found, key=lambda m: (m["item_id"] is None, m["item_id"] or 0, m["coverage"]))


def _slices(benchmark: DataFrame, tile: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in slices of at most ``SLICE_SEEDS`` seeds, brought to the driver one slice at a time."""
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = max(len(words(r[1])) - tile + 1, 1)
        if held and n + size > SLICE_SEEDS:
            yield held
            held, n = [], 0
        held.append((r[0], r[1]))
        n += size
    yield held


def flag(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE,
         name: str = "_matches") -> DataFrame:
    """``docs`` with a last column ``name``: array of (item_id, coverage, tiles, longest), empty for a clean document."""
    out, first = docs, True
    for items in _slices(benchmark, tile):
        out, first = _flag_slice(out, items, tile, coverage, name, first), False
    return out


def _flag_slice(docs: DataFrame, items: list, tile: int, coverage: float, name: str, first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    schema = StructType([*docs.schema, StructField(name, MATCHES)]) if first else docs.schema
    names = schema.names
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        seeds, kind = Seeds(sent.value, tile), to_arrow_type(MATCHES)
        for batch in batches:
            found = [matches(t.as_py() or "", seeds, coverage) if seeds.items else [] for t in batch.column(at)]
            columns = batch.columns
            if not first:
                found = [[*a, *b] for a, b in zip(columns.pop().to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated documents."""
    name = fresh(docs, "_matches")
    return flag(docs, benchmark, tile, coverage, name).where(F.size(name) == 0).drop(name)


def report(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), coverage (largest, 0 if clean), tiles, longest."""
    m = flag(docs.select("doc_id", "text"), benchmark, tile, coverage)
    best = lambda f: F.coalesce(F.array_max(F.transform("_matches", lambda x: x[f])), F.lit(0))
    return m.select("doc_id", (F.size("_matches") > 0).alias("contaminated"), F.size("_matches").cast("long").alias("n_items"),
                    F.array_sort(F.transform("_matches", lambda x: x["item_id"])).alias("item_ids"),
                    best("coverage").cast("double").alias("coverage"), best("tiles").cast("long").alias("tiles"),
                    best("longest").cast("long").alias("longest"))
