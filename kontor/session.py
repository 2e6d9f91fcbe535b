"""Session helpers.

`get_spark` builds the session used by tests and bench. On a cluster the
session already exists (spark-submit / notebook); `ensure_checkpoint_dir`
then only reads `spark.checkpoint.dir` and never overrides it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings that every job relies on (dates are keys, so UTC is pinned).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "kontor") -> SparkSession:
    running = SparkSession.getActiveSession()
    if running is not None:  # a cluster's session keeps its own sizing
        running.conf.set("spark.sql.session.timeZone", BASE_CONF["spark.sql.session.timeZone"])
        return running
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("KONTOR_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(key, BASE_CONF[key])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's `spark.checkpoint.dir` is used as is. Only when it is unset in local
    mode (tests, bench), where driver and executors are one process, a fresh scratch
    folder is created and registered; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="kontor-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` once as a Parquet table in the shared checkpoint folder
    and continue from it.

    A reliable cut: the files live in the cluster's shared folder, so a lost
    executor costs a re-read, not a recomputation of the lineage. Unlike
    `Dataset.checkpoint()` (which computes an uncached plan twice: once for
    the eager count, once to write), the plan runs exactly once, and the
    re-read gets column pruning and filter pushdown.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/kontor-tables/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that `cut_lineage` has written for this application (call when its results are stored)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-tables/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
