"""Versioned tables: one commit file names the files of all tables (A5), and writes touch few of them.

A store is a folder ``<root>``.  Data files lie under ``data/<table>/<write>`` and
never change.  ``versions/<n>.json`` is version n: per table its schema and its files, each with
its row count and the range of its key.  A write makes new data files, then puts the next version file in
place with one rename.  Readers take the newest version file, so they see all tables of one
version or of the one before, whatever a crash leaves behind.

* ``Replace``, ``Append``: whole tables, new rows.
* ``Update``: rows of a frame (key, some columns) set those columns of the rows with that key.
  Files are found by key range, then by ``_metadata.file_path`` of the rows that match; only files that hold
  such a row are written anew.  ``insert`` also adds rows whose key is new.

A write that carries the ``batch`` of the newest version or an older one is a replay and changes
nothing.  Tables of many small files are compacted in the same write; ``expire`` drops old versions
and the files that only they name.  One writer at a time is assumed, as for a stream with one
checkpoint.  File lists are driver state, as they are for Spark's own file index; rows are never collected.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.streaming.sinks import kept

MAX_FILES, TARGET_ROWS = 32, 2_000_000
_GRID = 1000


@dataclass
class Replace:
    """``keys``: the key column, where it can be read without working out the rows; the files' ranges then come from it."""
    df: DataFrame
    key: str | None = None
    keys: DataFrame | None = None


@dataclass
class Append:
    df: DataFrame
    key: str | None = None


@dataclass
class Update:
    df: DataFrame
    key: str = "id"
    insert: bool = False


def _whole(schema: T.StructType, key: str | None) -> bool:
    return key is not None and isinstance(schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType))


def _place(key: str, tops: list[int], first: int = 0) -> Column:
    """The range of a key: how many of the ascending ``tops`` it exceeds, searched by halves; null keys are in the first."""
    if not tops:
        return F.lit(first)
    mid = len(tops) // 2
    return F.when(F.coalesce(F.col(key) <= tops[mid], F.lit(True)), _place(key, tops[:mid], first)).otherwise(
        _place(key, tops[mid + 1:], first + mid + 1))


def _tops(files: list[dict]) -> list[int] | None:
    """The upper ends of the files' key ranges but the last; None where ranges meet or are unknown."""
    if any(f["low"] is None for f in files):
        return None
    files = sorted(files, key=lambda f: f["low"])
    return None if any(a["high"] >= b["low"] for a, b in zip(files, files[1:])) else [f["high"] for f in files[:-1]]


class Store:
    def __init__(self, spark: SparkSession, root: str, max_files: int = MAX_FILES, target_rows: int = TARGET_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.max_files, self.target_rows = max_files, target_rows

    # ------------------------------------------------------------ versions
    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        folder, fs = self._path(f"{self.root}/versions"), self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def describe(self, version: int | None = None) -> dict:
        """A version's content: ``tables``, ``batch`` and ``meta``."""
        version = self.latest() if version is None else version
        if version is None:
            return {"tables": {}, "batch": None, "meta": {}}
        stream = self._fs().open(self._path(f"{self.root}/versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, content: dict) -> None:
        fs, final = self._fs(), self._path(f"{self.root}/versions/{version}.json")
        if fs.exists(final):
            raise RuntimeError(f"version {version} was written by someone else")
        part = self._path(f"{self.root}/versions/.{version}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(part, final):
            raise RuntimeError(f"version {version} could not be put in place")

    # ------------------------------------------------------------ reading
    def _read(self, table: dict, files: list[dict] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        files = table["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in files])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest by default)."""
        tables = self.describe(version)["tables"]
        if name not in tables:
            raise KeyError(f"no table {name!r} in {self.root}")
        return self._read(tables[name])

    def lookup(self, name: str, keys: DataFrame, key: str = "id") -> DataFrame:
        """The rows of a table whose key is in ``keys`` (a column of that name); files without one are not read in full."""
        table = self.describe()["tables"][name]
        held = self._holding(table, keys, key)
        return self._read(table, held).join(keys.select(key).distinct(), key, "left_semi")

    # ------------------------------------------------------------ writing
    def write(self, changes: dict[str, Replace | Append | Update], batch: int | None = None, meta: dict | None = None) -> int:
        """Apply the changes to all tables as one new version; returns its number (or the newest, for a replayed batch)."""
        version, old = self.latest(), self.describe()
        if batch is not None and old["batch"] is not None and old["batch"] >= batch:
            return version
        tables = dict(old["tables"])
        for name, change in changes.items():
            tables[name] = self._changed(name, tables.get(name), change)
        new = 0 if version is None else version + 1
        self._publish(new, {"tables": tables, "batch": old["batch"] if batch is None else batch, "meta": old["meta"] | (meta or {})})
        return new

    def _changed(self, name: str, table: dict | None, change: Replace | Append | Update) -> dict:
        known = {f["path"] for f in (table or {"files": []})["files"]}
        if isinstance(change, Update):
            if table is None:
                raise KeyError(f"no table {name!r} to update")
            table = table | {"key": change.key, "files": self._updated(name, table, change)}
        else:
            stay = [] if table is None or isinstance(change, Replace) else table["files"]
            key = change.key or (table or {}).get("key")
            df = change.df if table is None or isinstance(change, Replace) else change.df.select(*T.StructType.fromJson(json.loads(table["schema"])).names)
            schema = df.schema.json() if table is None or isinstance(change, Replace) else table["schema"]
            tops = self._even(change.keys, key) if isinstance(change, Replace) and change.keys is not None and _whole(df.schema, key) else None
            table = {"schema": schema, "key": key, "files": stay + self._files(name, df, key, tops=tops)}
        if len(table["files"]) > self.max_files:
            before, table = table["files"], table | {"files": self._compacted(name, table)}
            named = {f["path"] for f in table["files"]} | known
            for f in before:
                if f["path"] not in named:  # written and compacted at once: no version ever names it
                    self._fs().delete(self._path(f["path"]), False)
        return table

    def _updated(self, name: str, table: dict, change: Update) -> list[dict]:
        key, types = change.key, {f.name: f.dataType for f in T.StructType.fromJson(json.loads(table["schema"])).fields}
        columns = [c for c in change.df.columns if c != key and c in types]
        # worked out once: files are found by it, and rows changed; as files its size is known, so joins with few rows need no shuffle
        given = kept(change.df.select(key, *[F.col(c).cast(types[c]).alias(c) for c in columns]), f"update-{name}")
        touched = self._holding(table, given, key)
        old = self._read(table, touched)
        new = given.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
        joined = old.join(new, old[key] == new["_key"], "left")
        rows = joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name)).alias(f.name)
                               if f.name in columns else F.col(f.name) for f in old.schema.fields])
        if change.insert:
            fresh = given.join(old.select(key), key, "left_anti")
            rows = rows.unionByName(fresh.select(*[(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                                   for f in old.schema.fields]))
        gone = {f["path"] for f in touched}
        stay = [f for f in table["files"] if f["path"] not in gone]
        if not touched and not change.insert:
            return stay
        tops = _tops(touched) if touched and table["key"] == key and not change.insert else None
        return stay + self._files(name, rows, key, max(len(touched), 1), tops)

    def _holding(self, table: dict, keys: DataFrame, key: str) -> list[dict]:
        """The files with a row whose key is among ``keys``."""
        files = table["files"]
        if table["key"] == key:
            low, high = keys.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
            if low is None:
                return []
            if low.lstrip("-").isdigit() and high.lstrip("-").isdigit():
                files = [f for f in files if f["low"] is None or (f["low"] <= int(high) and f["high"] >= int(low))]
        if not files:
            return []
        rows = self._read(table, files).select(F.col(key), F.col("_metadata.file_path").alias("_file"))
        hit = {r[0] for r in rows.join(keys.select(key), key, "left_semi").select("_file").distinct().collect()}
        return [f for f in files if f["path"] in hit]

    def _parts(self) -> int:
        """Files of a table written whole: no more than would be compacted at once."""
        return min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.max_files)

    def _even(self, keys: DataFrame, key: str) -> list[int]:
        """The upper ends of ranges of about equally many keys, at most about ``target_rows`` in each."""
        rows = keys.count()
        some = keys.sample(min(1.0, 200 * _GRID / max(rows, 1)), seed=0)  # for the ranges alone, as Spark samples for its own
        grid = some.agg(F.percentile_approx(key, [i / _GRID for i in range(1, _GRID)])).first()[0]
        n = min(max(self._parts(), -(-rows // self.target_rows)), _GRID)
        return sorted({grid[i * _GRID // n - 1] for i in range(1, n)}) if grid else []

    def _files(self, name: str, df: DataFrame, key: str | None, parts: int | None = None, tops: list[int] | None = None) -> list[dict]:
        """Write the rows, in ranges of the key where there is one; the files that hold rows.

        Ranges that are known (``tops``) spare Spark's look for some, which works out all rows once more.
        """
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        if tops is not None:
            df = df.repartitionById(len(tops) + 1, _place(key, tops))
        elif key is not None:
            df = df.repartitionByRange(parts or self._parts(), key)
        df.write.parquet(folder)
        whole = _whole(df.schema, key)
        bound = lambda f: f(F.col(key)).cast("long") if whole else F.lit(None).cast("long")
        found = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count("*").alias("rows"), bound(F.min).alias("low"), bound(F.max).alias("high"))
        files = sorted((r.asDict() for r in found.collect()), key=lambda f: f["path"])
        if not files:  # no rows: the empty file that Spark writes then is named by no version
            self._fs().delete(self._path(folder), True)
        return files

    def _compacted(self, name: str, table: dict) -> list[dict]:
        """Small files put together, so that a table of n rows keeps at most 2 n / target_rows large files and ``max_files`` small ones.

        A file is small with less than half of ``target_rows``: files written with about that many stay as they are.
        """
        small = [f for f in table["files"] if f["rows"] < self.target_rows // 2]
        if len(small) <= self.max_files // 2:
            return table["files"]
        n = max(-(-sum(f["rows"] for f in small) // self.target_rows), 1)
        rows = self._read(table, small)
        names = {f["path"] for f in small}
        return [f for f in table["files"] if f["path"] not in names] + self._files(
            name, rows if table["key"] else rows.repartition(n), table["key"], n)

    def expire(self, keep: int = 2) -> int:
        """Drop all versions but the newest ``keep``, and the files that only dropped versions name; returns how many files went."""
        versions = self.versions()
        drop, fs = versions[:-keep], self._fs()
        paths = lambda v: {f["path"] for t in self.describe(v)["tables"].values() for f in t["files"]}
        live = set().union(*(paths(v) for v in versions[-keep:]))
        dead = set().union(*(paths(v) for v in drop)) - live
        for v in drop:  # first the versions: a reader never finds one without its files
            fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        for path in dead:
            fs.delete(self._path(path), False)
        return len(dead)
