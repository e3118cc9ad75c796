"""Best-fit packing with a swap-based local search.

Map side, every document is encoded and cut into pieces of at most ``size``
tokens; only the pieces' figures travel.  Full pieces are sequences of their
own.  The others are dealt to groups of about ``group_pieces``; a group is
packed best-fit decreasing, then improved by a local search over its underfull
sequences: a document moves to another sequence, or is exchanged one-for-one or
two-for-one, whenever the sum of squared fills grows, so that light sequences
drain until they are empty.  What stays underfull after that is dealt anew to as many groups
of about ``group_pieces`` as it fills and packed again, level by level, until one group holds it, its
sequences are as few as the lower bound of all its pieces, or a level makes neither the
pieces left nor the sequences above that bound fewer by an eighth.

Defined cases: a null or empty text is its end id alone; each row is a document
(repeated rows are packed again, with their own places); a null ``doc_id`` is
kept; columns besides ``doc_id`` and ``text`` are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import chunks, stored
from tillroll.llm.tokens import CHARS, encoder

SIZE, GROUP_PIECES, FAN_IN = 4096, 8192, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def least_bins(lengths: list[int], size: int) -> int:
    """A lower bound on the sequences needed (Martello and Toth): pieces over half the size cannot share, and what is

    at least as long as the room they leave must go elsewhere, for every threshold a up to half the size.
    """
    return least_bins_of(*np.unique(np.asarray(lengths, np.int64), return_counts=True), size)


def least_bins_of(x: np.ndarray, counts: np.ndarray, size: int) -> int:
    """``least_bins`` of ``counts`` pieces of each of the ascending lengths ``x``."""
    if not len(x):
        return 0
    total, many = np.concatenate([[0], np.cumsum(x * counts)]), np.concatenate([[0], np.cumsum(counts)])
    half = np.searchsorted(x, size // 2, "right")
    a = np.unique(np.concatenate([[0], x[:half]]))
    lo, hi = np.searchsorted(x, a, "left"), np.maximum(np.searchsorted(x, size - a, "right"), half)
    large = many[-1] - many[half]
    room = (many[hi] - many[half]) * size - (total[hi] - total[half])
    return int((large + np.maximum(0, -(-(total[half] - total[lo] - room) // size))).max())


class _Bins:
    """Sequences of one group: item indices per bin, and the fills."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit_decreasing(self) -> None:
        by_room: list[list[int]] = [[] for _ in range(self.size + 1)]  # room -> bins
        rooms: list[int] = []  # distinct rooms in use, ascending
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[i]
            at = bisect.bisect_left(rooms, need)
            if at < len(rooms):
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
                self.items[b].append(i)
                self.fill[b] += need
            else:
                b, room = len(self.items), self.size
                self.items.append([i])
                self.fill.append(need)
            left = room - need
            if left:
                if not by_room[left]:
                    bisect.insort(rooms, left)
                by_room[left].append(b)

    def search(self) -> None:
        """Drain the lightest sequences: as many as the count exceeds its lower bound, until no exchange helps."""
        bound = least_bins(self.lengths, self.size)
        changed = True
        while changed:
            changed = False
            open_bins = sorted((f, b) for b, f in enumerate(self.fill) if 0 < f < self.size)
            spare = sum(1 for f in self.fill if f) - bound
            order = [b for _, b in open_bins]
            for a in order[:max(spare, 0)]:
                for b in reversed(order):  # fullest first
                    while a != b and self.fill[a] and self.fill[b] and self._improve(a, b):
                        changed = True

    def _improve(self, a: int, b: int) -> bool:
        """Shift the largest possible net length from bin a to bin b by a move, a one-for-one or a two-for-one exchange.

        Moving d from a to b changes the squares by 2 d (fill b - fill a + d): a gain if fill b + d > fill a.
        """
        lens, room = self.lengths, self.size - self.fill[b]
        if not room:
            return False
        theirs = sorted((lens[i], i) for i in self.items[b])
        keys = [x for x, _ in theirs]
        best, best_out, best_in = 0, None, ()
        for x in self.items[a]:
            n = lens[x]
            if n <= room and n > best:
                best, best_out, best_in = n, x, ()
            # One for one: the smallest partner that leaves the net length within the room.
            at = bisect.bisect_left(keys, n - room)
            if at < len(keys) and best < n - keys[at] <= room:
                best, best_out, best_in = n - keys[at], x, (theirs[at][1],)
            # Two for one: two pointers over the partner pairs with the smallest sum of at least n - room.
            lo, hi = 0, len(keys) - 1
            while lo < hi:
                pair = keys[lo] + keys[hi]
                if pair >= n - room:
                    if best < n - pair <= room:
                        best, best_out, best_in = n - pair, x, (theirs[lo][1], theirs[hi][1])
                    hi -= 1
                else:
                    lo += 1
        if best_out is None or self.fill[b] + best <= self.fill[a]:
            return False
        self.items[a].remove(best_out)
        self.items[b].append(best_out)
        for y in best_in:
            self.items[b].remove(y)
            self.items[a].append(y)
        self.fill[a] -= best
        self.fill[b] += best
        return True


def pack(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Item indices per sequence: best-fit decreasing, then the local search."""
    bins = _Bins(lengths, size)
    bins.best_fit_decreasing()
    bins.search()
    return [b for b in bins.items if b]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and a row number unique within the run."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(tokenizer).encode, TaskContext.get().partitionId() << 40
        for cols, texts in chunks(batches, chars=CHARS):
            rows: tuple[list, ...] = tuple([] for _ in range(6))
            for doc_id, ids in zip(cols["doc_id"], encode(texts)):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at:at + 4 * size]
                    row = doc_id, at // (4 * size), at // 4, len(part) // 4, zlib.crc32(part), uid
                    for col, v in zip(rows, row):
                        col.append(v)
                    uid += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _pack_groups(items: DataFrame, size: int, level: int) -> DataFrame:
    """Pack each group; ``done`` marks sequences that are full."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("uid", ignore_index=True)
        seq, offset, done = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64), np.zeros(len(df), bool)
        lengths = df["length"].tolist()
        for n, members in enumerate(pack(lengths, size)):
            at = 0
            for i in members:
                seq[i], offset[i] = n, at
                at += lengths[i]
            done[members] = at == size
        return pd.DataFrame({"uid": df["uid"], "length": df["length"], "done": done, "offset": offset,
                             "sequence_id": (np.int64(level) << 56) + (np.int64(key[0]) << 24) + seq, "group": key[0]})

    return items.groupBy("group").applyInPandas(
        run, "uid long, length long, done boolean, offset long, sequence_id long, group long")


def place(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    short = pieces.where(F.col("length") < size).select("uid", "length")
    left, above, level, placed = short.count(), math.inf, 1, None
    items = short
    while True:
        groups = max(math.ceil(left / group_pieces), 1)
        dealt = items.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        out = stored(_pack_groups(dealt, size, level), "packed")
        rest = out.where("not done")
        # At most one row for each length below the size comes to the driver.
        kinds = rest.groupBy("length").agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("firsts")).orderBy("length").collect()
        lengths, counts, firsts = (np.array([r[k] for r in kinds], np.int64) for k in range(3))
        before, left = (left, above), int(counts.sum())
        above = int(firsts.sum()) - least_bins_of(lengths, counts, size)
        stuck = left > before[0] * (1 - 1 / FAN_IN) and above > before[1] * (1 - 1 / FAN_IN)
        last = groups == 1 or not above or stuck
        done = (out if last else out.where("done")).select("uid", "sequence_id", "offset")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        items, level = rest.select("uid", "length"), level + 1
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < size).join(placed, "uid")
    return full.unionByName(rest).drop("uid")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    return place(stored(pieces(docs, tokenizer, end_id, size), "pieces"), size, group_pieces)
