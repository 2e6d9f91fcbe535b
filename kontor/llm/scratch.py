"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kontor.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table", codec: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: it is computed once,
    and a lost executor costs a read of files, not the lineage. `codec`: of the files, as `zstd` for whole texts."""
    path = scratch_dir(df.sparkSession, what)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the folders of `stored` tables that no later plan reads."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
