"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller ``doc_id``.

Documents are cut into shards of about ``shard_bytes`` bytes, stored once.  Then, with two
meetings by hash:

1. Regions.  A window of ``length`` bytes has a minimizer, the least hash among its
   ``GRAM``-byte strings; neighbouring windows with one minimizer are a region, about eleven windows.  Equal windows
   have equal minimizers, so they lie in regions of one hash group.  Each region sends 32 bits of its minimizer, a
   64-bit hash of its text and its document, and gets two bits back: a smaller
   document has the same region, so all its windows go; or else, another document has its minimizer, so its windows may repeat elsewhere.
2. Suffix arrays.  The text of the latter regions, each different one at most once in
   the corpus (but for repeats within a document), gets per shard a suffix array by Larsson-Sadakane refinement (ranks of h bytes
   refine the still unsorted groups to 2h bytes) and Kasai's common prefixes, many chains in
   lockstep.  Neighbours with a common prefix of ``length`` bytes are one class; windows outside the
   class's smallest document go.
3. Merging.  The windows left send a 64-bit key and their ``doc_id`` to their hash group (by a second, independent
   hash).  The shards' runs are sorted and merged, once for the keys and for the place of each; a window gets a bit
   back: a smaller document of another shard has it.
4. Spans.  Shards put the results together.  The union of the removed windows is
   the removed text.

Only hashes travel between shards: about one byte for each of text in step 1, and eight for each
window of step 3; text travels compressed, to meet its shard's bits.  A string in a third of all
documents is one window a shard in step 3, at most.  Two different texts are taken for equal only if 64 bits and
their group agree by chance.

Defined cases: a null text is empty; texts shorter than ``length`` bytes stay whole;
documents with the same ``doc_id`` (repeated rows, too) remove nothing from each other, and each
row is reported; a null ``doc_id`` is neither smaller nor larger than any, so such rows stay whole and remove nothing; a text of more than
``shard_bytes`` is cut into overlapping pieces, put together at the end; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import mix, stored

LENGTH, GRAM, SHARD_BYTES, GROUP_BYTES = 50, 28, 1_900_000, 16 << 20
_END = 0xFF  # no UTF-8 text holds this byte
_CHAIN, _STEP = 64, 1 << 16
SHARDS = "shard long, n_bytes long, uids array<long>, doc_ids array<long>, starts array<long>, sizes array<long>, pieces array<int>, content binary"
KEYS = "shard long, part int, content binary, more binary, n long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
PARTS = "uid long, start long, content binary, " + RESULT


# ------------------------------------------------------------------ hashes

@cache
def _bytes_hash(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32) + np.uint64(1))


def gram_hashes(t: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every ``n``-byte string of ``t`` (a polynomial, put together from powers of two, then mixed)."""
    out = np.empty(max(len(t) - n + 1, 0), np.uint64)
    base = 0x9E3779B97F4A7C15 + 2 * seed
    for at in range(0, len(out), _STEP):
        x = _bytes_hash(seed)[t[at:at + _STEP + n - 1]]
        size, power, left, acc, have = 1, base, n, None, 0
        while True:  # x holds the hashes of ``size`` bytes
            if left & 1:
                acc = x if acc is None else x[:len(x) - have] * np.uint64(pow(base, have, 1 << 64)) + acc[size:]
                have += size
            left >>= 1
            if not left:
                break
            x = x[:-size] * np.uint64(power) + x[size:]
            size, power = 2 * size, power * power % (1 << 64)
        out[at:at + _STEP] = mix(acc[:min(_STEP, len(out) - at)])
    return out


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    out = np.empty(max(len(h) - n + 1, 0), h.dtype)
    for at in range(0, len(out), _STEP):
        x, size = h[at:at + _STEP + n - 1], 1
        while 2 * size <= n:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        if size < n:
            x = np.minimum(x[:len(x) - (n - size)], x[n - size:])
        out[at:at + _STEP] = x
    return out


# ------------------------------------------------------------------ suffix arrays

def _order(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``key`` (whole numbers up to ``most``) in ascending order, and the sorted key.

    Key and place in one 64-bit number are sorted several times faster than places by their key.
    """
    bits = max(len(key) - 1, 1).bit_length()
    if most.bit_length() + bits <= 64:
        both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def suffix_array(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` in the order of their first ``depth`` bytes at least, and where each group of equal ones begins.

    The end sorts before every byte; equal ones stand in the order of their places.  ``t`` must end with ``_END``.
    """
    n = len(t)
    h = 5  # five bytes and the place of three bytes' worth fit one number
    first = np.zeros(n, np.uint64)
    padded = np.concatenate([t, np.zeros(h, np.uint8)])
    for i in range(h):
        first = (first << np.uint64(8)) | padded[i:i + n]
    sa, own = _order(first, (1 << 8 * h) - 1)
    starts = np.concatenate([[True], own[1:] != own[:-1]]) if n else np.empty(0, bool)
    # A group's rank is the place of its first suffix, counted from 1; 0 stands for the end of the text.
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(starts, np.arange(1, n + 1), 0))
    unsorted = lambda: np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    while h < depth and n:
        # Larsson-Sadakane: only groups of more than one suffix are refined, by the ranks of the suffixes h further on.
        at = unsorted()
        if not len(at):
            break
        sub = sa[at]
        order, key = _order(rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)], n * (n + 2))
        sub = sub[order]
        sa[at] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts[at] = new
        rank[sub] = np.maximum.accumulate(np.where(new, at + 1, 0))
        h *= 2
    if n and len(at := unsorted()):
        sub = sa[at]
        sa[at] = sub[_order(rank[sub] * (n + 1) + sub, n * (n + 2))[0]]
    return sa, starts


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai: per place of ``sa`` the common prefix with the suffix before it, up to ``most`` bytes.

    A suffix shares with its predecessor at least one byte less than the suffix one place to its left did,
    unless that one was equal to its predecessor as far as the order goes: then counting begins anew.
    Chains of ``_CHAIN`` places go along the text in lockstep.
    """
    n = len(t)
    padded = np.concatenate([t, np.full(most + 1, _END, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    equal = np.empty(n, bool)
    equal[sa] = ~starts
    by_place = np.zeros(n, np.int16)
    length, tied = np.zeros(-(-n // _CHAIN), np.int64), np.zeros(-(-n // _CHAIN), bool)
    for step in range(min(_CHAIN, n)):
        i = np.arange(step, n, _CHAIN)
        j = before[i]
        length = np.where(tied[:len(i)] | (j < 0), 0, np.maximum(length[:len(i)] - 1, 0))
        tied = equal[i]
        length[tied] = most
        live = np.flatnonzero((j >= 0) & ~tied)
        while len(live):
            at = length[live]
            more = (at < most) & (np.maximum(i[live], j[live]) + at < n)
            more &= padded[i[live] + at] == padded[j[live] + at]
            live = live[more]
            length[live] += 1
        by_place[i] = length
    return by_place[sa]


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], return_inverse: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct keys of all runs of (keys, documents), ascending, with each key's smallest and largest document.

    Sorted runs are merged by numpy's stable sort, which finds them and merges neighbours, by binary search as far as
    one lies outside the other.  Keys of 32 bits are sorted together with their places instead, which is faster.
    With ``return_inverse``, also where each key of the runs, one after the other, stands among the distinct ones.
    """
    keys, docs = (np.concatenate(x) for x in zip(*runs))
    if keys.itemsize > 4:
        ends = np.cumsum([len(k) for k, _ in runs])
        run = np.concatenate([np.argsort(k) + end - len(k) for (k, _), end in zip(runs, ends)])
        order = run[np.argsort(keys[run], kind="stable")]
        keys = keys[order]
    else:
        order, keys = _order(keys, np.iinfo(keys.dtype).max)
    docs = docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    out = keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    if not return_inverse:
        return out
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return *out, inverse


# ------------------------------------------------------------------ one shard

class Shard:
    """A shard's text with the places where a window may start."""

    def __init__(self, row: dict, length: int):
        self.row, self.length = row, length
        sizes = np.array(row["sizes"], np.int64)
        self.text = np.frombuffer(_unzip(row["content"], int(sizes.sum())), np.uint8)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.docs = np.array([i or 0 for i in row["doc_ids"]], np.int64)
        self.n = max(len(self.text) - length + 1, 0)
        # Windows start where they end inside their document.
        usable = (sizes >= length) & np.array([i is not None for i in row["doc_ids"]], bool)
        self.starts = _filled(self.begins[usable], self.ends[usable] - length + 1, self.n)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        """The document at each place."""
        return self.docs[np.searchsorted(self.ends, places, "right")]

    def regions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimizer, first window and end of each run of neighbouring windows of one document with one minimizer.

        A run of more windows than a minimizer can serve (a periodic text) is cut.
        """
        gram = min(GRAM, self.length)
        least = _least(gram_hashes(self.text, gram, 0), self.length - gram + 1)
        cut = np.empty(self.n, bool)
        if self.n:
            cut[0], cut[1:] = True, (least[1:] != least[:-1]) | (self.starts[1:] != self.starts[:-1])
        cut[self.begins[self.begins < self.n]] = True
        first, most = np.flatnonzero(cut), self.length - gram + 1
        end = np.append(first[1:], self.n)
        own = self.starts[first]
        first, end = first[own], end[own]
        pieces = -(-(end - first) // most)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, end = np.repeat(first, pieces) + step * most, np.repeat(end, pieces)
        end = np.minimum(end, first + most)
        return mix(least[first]), first, end  # a minimum is a small number: mixed again, it is spread

    def stretches(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text under the windows of a mask, an end mark after each stretch; the windows' places there, and here."""
        n, places = self.length, np.flatnonzero(windows)
        if not len(places):
            return np.empty(0, np.uint8), places, places
        new = np.flatnonzero(np.diff(places) >= n) + 1  # else two windows touch, be it in two documents: then
        fresh = np.concatenate([[0], np.union1d(new, np.searchsorted(places, self.begins[(self.begins > places[0]) & (self.begins <= places[-1])]))])
        begin = places[fresh]
        end = np.append(places[fresh[1:] - 1], places[-1]) + n
        sizes = end - begin + 1
        at = np.cumsum(sizes) - sizes  # stretch's begin in the new text
        shift = np.repeat(begin - at, sizes)
        source = np.arange(sizes.sum()) + shift
        marks = at + sizes - 1
        source[marks] = 0
        text = self.text[source]
        text[marks] = _END
        return text, places - np.repeat(begin - at, np.diff(np.append(fresh, len(places)))), places


def _filled(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of ``n`` places, true in all [begin, end); the begins differ, and so do the ends."""
    edge = np.zeros(n + 1, np.int8)
    edge[begins] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:n], dtype=np.int8).astype(bool)


def _zip(data: np.ndarray) -> bytes:
    return pa.compress(data.tobytes(), "zstd", asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def _unpack(data: bytes, n: int) -> np.ndarray:
    """``n`` bits, packed and compressed."""
    return np.unpackbits(np.frombuffer(_unzip(data, -(-n // 8)), np.uint8), count=n).astype(bool)


def _group(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash group of each hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_group(groups: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its members in ascending order) of the groups that have members."""
    order, _ = _order(groups, parts)
    cuts = np.searchsorted(groups[order], np.arange(parts + 1))
    return ((p, order[cuts[p]:cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1])


def _flags(rows: list[dict], groups: np.ndarray, name: str) -> np.ndarray:
    """Bits that came back from the hash groups, in the order of the members that were sent."""
    out = np.zeros(len(groups), bool)
    for (p, own), r in zip(_by_group(groups, max(int(groups.max(initial=0)) + 1, 1)), sorted(rows, key=lambda r: r["part"]), strict=True):
        if r["part"] != p:
            raise ValueError("the bits of a hash group are missing")
        out[own] = _unpack(r[name], len(own))
    return out


def _classes(shard: Shard, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the mask that stand in a smaller document of this shard as well; all windows' places."""
    text, at, places = shard.stretches(windows)
    sa, starts = suffix_array(text, shard.length)
    new = common_prefixes(text, sa, starts, shard.length) < shard.length
    here = np.full(len(text), -1, np.int64)
    here[at] = np.arange(len(at))
    own = here[sa]  # suffixes with a common prefix of a window stand together, all of them windows
    number, own = np.cumsum(new)[own >= 0], own[own >= 0]
    docs = shard.doc_of(places)[own]
    gone = np.zeros(len(places), bool)
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        gone[own] = docs > np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(own))))
    return gone, places


def _hashes_at(shard: Shard, windows: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the windows of a mask, by each seed."""
    text, at, _ = shard.stretches(windows)
    return [gram_hashes(text, shard.length, seed)[at] if len(at) else np.empty(0, np.uint64) for seed in seeds]


# ------------------------------------------------------------------ steps

def _batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))


_LONGS = pa.list_(pa.int64())
_KINDS = {
    "shards": {"shard": pa.int64(), "n_bytes": pa.int64(), "uids": _LONGS, "doc_ids": _LONGS, "starts": _LONGS, "sizes": _LONGS,
               "pieces": pa.list_(pa.int32()), "content": pa.binary()},
    "keys": {"shard": pa.int64(), "part": pa.int32(), "content": pa.binary(), "more": pa.binary(), "n": pa.int64()},
    "result": {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": _LONGS},
}
_KINDS["parts"] = {"uid": pa.int64(), "start": pa.int64(), "content": pa.binary()} | _KINDS["result"]


def shards(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One stored row per shard: its pieces' documents, places and sizes, and their text, compressed."""
    step = max(shard_bytes, 2 * length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_shards, uid = TaskContext.get().partitionId(), 0, TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            uids, ids, starts, texts, pieces = zip(*held)
            return _batch([{"shard": (part << 32) + n_shards, "n_bytes": size, "uids": uids, "doc_ids": ids, "starts": starts,
                            "sizes": [len(t) for t in texts], "pieces": pieces,
                            "content": pa.compress(b"".join(texts), "zstd", asbytes=True)}], _KINDS["shards"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                cuts = range(0, max(len(text) - length + 1, 1), step)  # every window starts in one piece
                for k, start in enumerate(cuts):
                    end = len(text) if k == len(cuts) - 1 else start + step + length - 1
                    if held and size + end - start > step:
                        yield out()
                        held, size, n_shards = [], 0, n_shards + 1
                    held.append((uid, doc_id, start, text[start:end], len(cuts)))
                    size += end - start
                uid += 1
        if held:
            yield out()

    text = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return stored(own.mapInArrow(run, SHARDS), "suffix-shards")


def _send_regions(table: DataFrame, length: int, parts: int) -> DataFrame:
    """Per shard and hash group: 32 bits of the regions' minimizers, then the hashes of their texts; their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], length)
                least, first, end = shard.regions()
                docs = shard.doc_of(first)
                if not len(first):
                    continue
                # A region is shorter than two windows: its first, its last and its size tell its text.
                h = gram_hashes(shard.text, length, 1)
                whole = mix(h[first] + mix(h[end - 1] + (end - first).astype(np.uint64)))
                yield _batch([{"shard": shard.row["shard"], "part": p, "n": len(own), "more": _zip(docs[own]),
                               "content": least[own].astype(np.uint32).tobytes() + whole[own].tobytes()}
                              for p, own in _by_group(_group(least, parts), parts)], _KINDS["keys"])

    return table.mapInArrow(run, KEYS)


def _judge_regions(sent: DataFrame) -> DataFrame:
    """Two bits per region: ``content``, a smaller document has it; ``more``, another document has its minimizer."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = [np.frombuffer(_unzip(r["more"], 8 * r["n"]), np.int64) for r in rows]
        least = [np.frombuffer(r["content"], np.uint32, r["n"]) for r in rows]
        whole = [np.frombuffer(r["content"], np.uint64, r["n"], 4 * r["n"]) for r in rows]
        _, low, high, own = merge_runs(list(zip(least, docs)), return_inverse=True)
        shared = (low < high)[own]
        # Equal texts have equal minimizers, so a text can be another document's only where its minimizer is.
        asked, known = np.flatnonzero(shared), np.zeros(len(shared), bool)
        docs, cuts = np.concatenate(docs), np.cumsum([r["n"] for r in rows])[:-1]
        _, low, _, own = merge_runs([(np.concatenate(whole)[asked], docs[asked])], return_inverse=True)
        known[asked] = low[own] < docs[asked]
        out = [{"shard": r["shard"], "part": r["part"], "n": r["n"], "content": _zip(np.packbits(k)), "more": _zip(np.packbits(m))}
               for r, k, m in zip(rows, np.split(known, cuts), np.split(shared, cuts))]
        return pa.Table.from_batches([_batch(out, _KINDS["keys"])])

    return sent.groupBy("part").applyInArrow(run, KEYS)


def _send_windows(table: DataFrame, judged: DataFrame, length: int, parts: int) -> DataFrame:
    """Per shard the windows that go and those that still may (a negative ``part``), and the latter's keys and documents."""
    def run(own: pa.Table, bits: pa.Table) -> pa.Table:
        row, = own.to_pylist()
        shard, given, out = Shard(row, length), bits.to_pylist(), []
        least, first, end = shard.regions()
        groups = _group(least, parts)
        known = _flags(given, groups, "content")
        asked = _flags(given, groups, "more") & ~known
        gone = _filled(first[known], end[known], shard.n)
        left = _filled(first[asked], end[asked], shard.n)
        here, places = _classes(shard, left)
        gone[places[here]], left[places[here]] = True, False
        keys, second = _hashes_at(shard, left, (1, 2))
        docs = shard.doc_of(np.flatnonzero(left))
        out = [{"shard": row["shard"], "part": p, "n": len(mine), "content": keys[mine].tobytes(), "more": _zip(docs[mine])}
               for p, mine in _by_group(_group(second, parts), parts)]
        out.append({"shard": row["shard"], "part": -1 - row["shard"] % parts, "n": 0,
                    "content": _zip(np.packbits(gone)), "more": _zip(np.packbits(left))})
        return pa.Table.from_batches([_batch(out, _KINDS["keys"])])

    return table.groupBy("shard").cogroup(judged.groupBy("shard")).applyInArrow(run, KEYS)


def _merge_windows(sent: DataFrame) -> DataFrame:
    """A bit per window: a smaller document has it.  What shards send to themselves passes through."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        rows = table.to_pylist()
        runs = [(np.frombuffer(r["content"], np.uint64), np.frombuffer(_unzip(r["more"], 8 * r["n"]), np.int64)) for r in rows]
        _, low, _, own = merge_runs(runs, return_inverse=True)
        known = np.split(low[own] < np.concatenate([d for _, d in runs]), np.cumsum([r["n"] for r in rows])[:-1])
        return pa.Table.from_batches([_batch(
            [{"shard": r["shard"], "part": r["part"], "n": r["n"], "content": _zip(np.packbits(k))} for r, k in zip(rows, known)], _KINDS["keys"])])

    return sent.groupBy("part").applyInArrow(run, KEYS)


def _spans(starts: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs covered by windows of ``n`` bytes at the ascending places, as begin, end, begin, end ..."""
    if not len(starts):
        return np.empty(0, np.int64)
    gap = np.flatnonzero(np.diff(starts) > n)
    begin = starts[np.concatenate([[0], gap + 1])]
    end = starts[np.append(gap, len(starts) - 1)] + n
    return np.stack([begin, end], 1).ravel()


def _join_spans(spans: np.ndarray) -> list[int]:
    """Union of spans that begin in ascending order."""
    out: list[int] = []
    for begin, end in spans.reshape(-1, 2).tolist():
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def _result(doc_id: int | None, text: bytes, spans: list[int]) -> dict:
    kept, at = hashlib.sha256(), 0
    for begin, end in zip(spans[::2], spans[1::2]):
        kept.update(text[at:begin])
        at = end
    kept.update(text[at:])
    removed = sum(spans[1::2]) - sum(spans[::2])
    return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": removed, "n_spans": len(spans) // 2,
            "kept_sha256": kept.hexdigest(), "spans": spans}


def _own_spans(table: DataFrame, found: DataFrame, length: int, parts: int) -> DataFrame:
    """The results of whole documents; of documents in pieces, each piece's text and removed spans."""
    def run(own: pa.Table, bits: pa.Table) -> pa.Table:
        row, = own.to_pylist()
        shard, given, out = Shard(row, length), bits.to_pylist(), []
        local, = (r for r in given if r["part"] < 0)
        gone, left = _unpack(local["content"], shard.n), _unpack(local["more"], shard.n)
        second, = _hashes_at(shard, left, (2,))
        gone[np.flatnonzero(left)] = _flags([r for r in given if r["part"] >= 0], _group(second, parts), "content")
        removed = np.flatnonzero(gone)
        cuts = np.searchsorted(removed, np.append(shard.begins, len(shard.text)))
        raw = shard.text.tobytes()
        for k, (uid, doc_id) in enumerate(zip(row["uids"], row["doc_ids"])):
            b = int(shard.begins[k])
            text, spans = raw[b:int(shard.ends[k])], _spans(removed[cuts[k]:cuts[k + 1]] - b, length).tolist()
            done = _result(doc_id, text, spans) if row["pieces"][k] == 1 else {"doc_id": doc_id, "spans": spans, "content": text}
            out.append(done | {"uid": uid, "start": row["starts"][k]})
        return pa.Table.from_batches([_batch(out, _KINDS["parts"])])

    return table.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, PARTS)


def _put_together(parts: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        text, spans = b"", []
        for r in rows:
            text = text[:r["start"]] + r["content"]  # pieces overlap by the length of a window less one
            spans += [s + r["start"] for s in r["spans"]]
        return pa.Table.from_batches([_batch([_result(rows[0]["doc_id"], text, _join_spans(np.array(spans, np.int64)))], _KINDS["result"])])

    cut = parts.where("content IS NOT NULL").groupBy("uid").applyInArrow(run, RESULT)
    return parts.where("content IS NULL").select(cut.columns).unionByName(cut)


def removed(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end, begin, end ... in bytes) per row of ``docs``."""
    spark = docs.sparkSession
    cut = shards(docs, length, shard_bytes)
    n, size = cut.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    parts = max(math.ceil(size / GROUP_BYTES), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    judged = stored(_judge_regions(_send_regions(cut, length, parts)), "suffix-regions")
    found = stored(_merge_windows(_send_windows(cut, judged, length, parts)), "suffix-windows")
    return _put_together(stored(_own_spans(cut, found, length, parts), "suffix-spans"))


def dedup(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``."""
    return removed(docs, length, shard_bytes).drop("spans")
