"""Shared helpers: table access, intermediate tables in the shared folder, words and their hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh64_intdigest

from tillroll.session import checkpoint_dir

_WORD = re.compile(r"\w+")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can see; the files go when
    the session's JVM ends.  Shuffle files of the write are of no use after it and go at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[tuple[dict, list[str]]]:
    """Slices of Arrow batches as (columns as lists, texts with null as empty); at most ``chars`` characters or one row each."""
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != text}
        texts = batch.column(batch.schema.get_field_index(text))
        n = batch.num_rows
        start, size, held = 0, 0, []
        for i in range(n):
            t = texts[i].as_py() or ""
            held.append(t)
            size += len(t)
            if size >= chars or i == n - 1:
                yield {c: v[start:i + 1] for c, v in cols.items()}, held
                start, size, held = i + 1, 0, []


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def hash_words(ws: list[str]) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    return np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive word hashes (Karp-Rabin polynomial modulo 2^64, then mixed)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _MULT + h[i:len(h) - n + 1 + i]
    return mix(out)


def shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct window hashes; a text of 1 to ``n`` - 1 words has one shingle, its whole word sequence."""
    if len(h) == 0:
        return np.empty(0, np.uint64)
    return np.unique(windows(h, min(n, len(h))))
