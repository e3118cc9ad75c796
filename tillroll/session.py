"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is created by the launcher; everything here only
fills in settings that are still unset, so cluster configuration wins.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the package relies on.  AQE re-plans joins from
# runtime sizes (broadcast when a side turns out small, skew splitting when a
# key is hot) and coalesces small shuffle partitions.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tillroll", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in _DEFAULTS.items():
        if k != "spark.ui.enabled" and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark

#: What Spark takes a frame of unknown size for, in bytes.
_UNKNOWN_SIZE = (1 << 63) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name it.  Only on a local master, where driver and executors
    are one process, a private temporary folder stands in; it goes when the session ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{configured}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the shared checkpoint folder.

    A checkpoint keeps its plan's estimated size, and a join's estimate is the product of its sides'.  A loop that joins what
    it checkpointed doubles the digits of that number each time, up to hundreds of MB in the driver.  An
    estimate above every size is therefore dropped: the frame is then one of unknown size, like any RDD."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() <= _UNKNOWN_SIZE:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)
