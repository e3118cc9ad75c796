"""Token-ID output in patched frame-of-reference blocks.

Documents are range-partitioned by ``doc_id``; each task encodes its documents
in ascending order and cuts their ids into files.  A file is
self-contained bytes: header, document lengths, block index, blocks, exceptions.
Files are stored as rows of a Parquet table in the shared folder, so writing
goes through Spark's committer and survives lost executors on any file system.

File format (little-endian).  ``PFR1``, then uint32 n_docs, n_blocks, n_ids.
Per document int64 doc_id, uint8 is-null, uint32 n_ids.  The index: per block uint32
start of the block's bytes and of its exceptions, from the block area's
begin.  A block holds up to 1024 ids: uint32 minimum, uint8 bit width, uint16
count, uint16 exceptions; then (id - minimum) packed at that width, low bits
first, zero where an exception stands; then the exceptions as uint16 place and
uint32 offset from the minimum.  The width covers the ``PERCENTILE`` of the
block's offsets.

Defined cases: null text is empty (the end id alone); equal ``doc_id``s are
ordered by their texts' xxhash64 and all written; null ids come first; other columns are not
read; an empty table writes no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import chunks, stored
from tillroll.llm.tokens import CHARS, encoder

BLOCK, PERCENTILE, FILE_IDS = 1024, 90, 1 << 18
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIII"), struct.Struct("<IBHH")
_EXCEPTION = np.dtype([("place", "<u2"), ("value", "<u4")])
FILES = "part int, file int, before long, n_ids long, n_docs long, content binary"


def pack_block(ids: np.ndarray) -> tuple[bytes, int]:
    """The bytes of one block and the place of its exceptions in them."""
    low = int(ids.min())
    off = ids.astype(np.uint32) - np.uint32(low)
    typical = int(np.partition(off, (len(off) - 1) * PERCENTILE // 100)[(len(off) - 1) * PERCENTILE // 100])
    width = typical.bit_length()
    out = np.flatnonzero(off >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = off.copy()
    packed[out] = 0
    bits = np.unpackbits(packed.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    body = _BLOCK_HEAD.pack(low, width, len(ids), len(out)) + np.packbits(bits.ravel(), bitorder="little").tobytes()
    patches = np.empty(len(out), _EXCEPTION)
    patches["place"], patches["value"] = out, off[out]
    return body + patches.tobytes(), len(body)


def unpack_block(data: bytes, start: int, exceptions: int) -> np.ndarray:
    low, width, n, n_out = _BLOCK_HEAD.unpack_from(data, start)
    at = start + _BLOCK_HEAD.size
    packed = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    off = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    patches = np.frombuffer(data, _EXCEPTION, n_out, exceptions)
    off[patches["place"]] = patches["value"]
    return off + np.uint32(low)


def write_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """One file of documents given as (doc_id, ids as uint32 bytes)."""
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    directory = b"".join(struct.pack("<qBI", i or 0, i is None, len(d) // 4) for i, d in docs)
    bodies, index, at = [], [], 0
    for k in range(0, len(ids), BLOCK):
        body, exceptions = pack_block(ids[k:k + BLOCK])
        index.append((at, at + exceptions))
        bodies.append(body)
        at += len(body)
    return b"".join([_HEAD.pack(b"PFR1", len(docs), len(index), len(ids)), directory,
                     np.array(index, "<u4").tobytes(), *bodies])


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document, in file order."""
    magic, n_docs, n_blocks, _ = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a patched frame-of-reference file")
    heads = list(struct.iter_unpack("<qBI", data[_HEAD.size:_HEAD.size + 13 * n_docs]))
    at = _HEAD.size + 13 * n_docs
    index = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(n_blocks, 2)
    area = at + 8 * n_blocks
    ids = np.concatenate([unpack_block(data, area + int(s), area + int(e)) for s, e in index] or [np.empty(0, np.uint32)])
    done = 0
    for doc_id, null, n in heads:
        yield None if null else doc_id, ids[done:done + n]
        done += n


def write(docs: DataFrame, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all documents; returns the stored file table (``FILES``)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = before = n_files = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([n_files], pa.int32()), pa.array([before], pa.int64()),
                pa.array([size], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([write_file(held)], pa.binary())],
                ["part", "file", "before", "n_ids", "n_docs", "content"])

        for cols, texts in chunks(batches, chars=CHARS):
            for doc_id, ids in zip(cols["doc_id"], encode(texts)):
                held.append((doc_id, ids + end))
                size += len(held[-1][1]) // 4
                if size >= file_ids:
                    yield out()
                    before, size, n_files, held = before + size, 0, n_files + 1, []
        if held:
            yield out()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # The text's hash stands in for it: what the driver samples to find the ranges holds no texts.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(parts, *order).sortWithinPartitions(*order, "text"))
    return stored(ordered.mapInArrow(run, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, decoded from the files."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # One row per writing task: their running sum is the only global step.
    first = totals.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("first"))
    placed = files.join(F.broadcast(first), "part").select((F.col("first") + F.col("before")).alias("start"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, ids in read_file(content.as_py()):
                    for col, v in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        col.append(v)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
