"""Idempotent sinks for Structured Streaming, all in the shared checkpoint folder.

``run_update_stream`` — runs an update-mode aggregate with ``foreachBatch``;
each micro-batch writes its changed rows to ``<out>/batch_id=<n>`` (a replay of
batch n overwrites the same folder), and the current result is the newest
version of every key across batches.

``commit_snapshot`` (A5) — all-or-nothing multi-table commit: the tables of
one batch are written under ``<root>/snapshots/<table>/batch_id=<n>``, and
only then a commit marker ``<root>/commits/batch_id=<n>`` is written.  Readers
take the newest batch that has a marker, so a half-written batch is never
seen and a replayed batch overwrites its own snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.joins import first_per_key
from tillroll.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tillroll/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back; the files go when the session's JVM ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there.  Any other trouble with the file system is raised, never taken for "empty"."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_update_stream(stream: DataFrame, keys: list[str], out: str, trigger_once: bool = True,
                      on_batch=None) -> DataFrame:
    """Run ``stream`` (an aggregate) in update mode until the input is drained;
    return the latest row per key as a batch DataFrame read from ``out``."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")
        if on_batch is not None:
            on_batch(df, batch_id)

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{out}/_checkpoint"))
    q = q.trigger(availableNow=True) if trigger_once else q
    handle = q.start()
    handle.awaitTermination()
    spark = stream.sparkSession
    cols = list(stream.columns)
    schema = T.StructType(list(stream.schema.fields) + [T.StructField("batch_id", T.LongType())])
    if not exists(spark, f"{out}/data"):  # no batch had rows
        return spark.createDataFrame([], stream.schema)
    res = spark.read.schema(schema).parquet(f"{out}/data")
    return first_per_key(res, keys, ["batch_id"], latest=True).select(*cols)


def commit_snapshot(frames: dict[str, DataFrame], root: str, batch_id: int, meta: dict | None = None) -> None:
    """A5: write every table of one batch, then its commit marker (with ``meta`` scalars)."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/snapshots/{name}/batch_id={batch_id}")
    spark = next(iter(frames.values())).sparkSession
    cols = [F.lit(batch_id).cast("long").alias("batch_id"), F.lit(sorted(frames)).alias("tables")]
    cols += [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    spark.range(1).select(*cols).write.mode("overwrite").parquet(f"{root}/commits/batch_id={batch_id}")


def last_committed(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest batch id with a commit marker (below ``before`` when given)."""
    if not exists(spark, f"{root}/commits"):  # nothing committed yet
        return None
    c = spark.read.parquet(f"{root}/commits")
    if before is not None:
        c = c.filter(F.col("batch_id") < before)
    r = c.agg(F.max("batch_id").alias("b")).first()
    return None if r is None else r["b"]


def commit_meta(spark: SparkSession, root: str, batch_id: int) -> dict:
    """The scalars stored with a batch's commit marker."""
    return spark.read.parquet(f"{root}/commits/batch_id={batch_id}").first().asDict()


def read_snapshot(spark: SparkSession, root: str, table: str, batch_id: int | None = None) -> DataFrame:
    b = last_committed(spark, root) if batch_id is None else batch_id
    if b is None:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    return spark.read.parquet(f"{root}/snapshots/{table}/batch_id={b}")
