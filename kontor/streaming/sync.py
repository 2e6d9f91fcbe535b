"""M6: incremental change-feed sync as a Structured Streaming job.

The feed directory is a file stream source. Each micro-batch is one sync: upserts (M1) then
removals (M2), kept as a run of net entries, one per id: new values with the account of the event that first named the
id, or `gone`. The ledger is a table of runs (kontor.sources.runs), merged on read: a sync reads nothing of the ledger
and writes in proportion to the ids it names.

A commit also names the feed files it applied, so a file is applied once, whatever the stream's checkpoint says: a sync that
failed, a replayed batch and a lost or new checkpoint neither lose nor repeat changes. Rows of
unknown accounts go to a quarantine table, and the last position of every account's feed to a cursor table; their
rows count once their sync is committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.ingest import quarantine_orphans, sync
from kontor.session import cut_lineage
from kontor.sources.runs import RunTable
from kontor.sources.tables import LEDGER_COLUMNS, LEDGER_SCHEMA

FEED_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("external_account_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("pending", T.BooleanType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])

#: Net change of an id: `reset`, entries before this one no longer count; without values the id is gone.
ENTRIES = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("reset", T.BooleanType()), T.StructField("gone", T.BooleanType())])
QUARANTINE = T.StructType([*FEED_SCHEMA.fields, T.StructField("sync", T.StringType())])
CURSORS = "external_account_id string, cursor long, sync string"
FILES = "file string, sync string"


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def newest_entry(entries: DataFrame, whole: bool) -> DataFrame:
    """Fold of ENTRIES: the values of the last entry, the account of the first since the id was last gone."""
    since = F.max(F.when(F.col("reset"), F.col("_seq"))).over(Window.partitionBy("transaction_id"))
    alive = entries.withColumn("_since", since).filter(F.col("_since").isNull() | (F.col("_seq") >= F.col("_since")))
    values = [c for c in LEDGER_COLUMNS if c not in ("transaction_id", "account_id")]
    folded = alive.groupBy("transaction_id").agg(
        F.max_by(F.struct(*values, "gone"), "_seq").alias("_v"), F.max("reset").alias("reset"),
        F.min_by(F.struct("account_id"), F.when(~F.col("gone"), F.col("_seq"))).alias("_a"))
    out = folded.select("transaction_id", "_a.account_id", "_v.*", "reset")
    return out.filter(~F.col("gone")).withColumn("reset", F.lit(False)) if whole else out


def ledger_table(spark: SparkSession, ledger_dir: str) -> RunTable:
    return RunTable(spark, ledger_dir, ENTRIES, ["transaction_id"], newest_entry)


def net_entries(changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """One sync's ENTRIES: upserted rows without what it removes, and the removed ids."""
    spark = changes.sparkSession
    upserts = sync(spark.createDataFrame([], LEDGER_SCHEMA), changes, accounts)
    removed = changes.filter(F.col("kind") == "removed").select("transaction_id").distinct()
    return (upserts.withColumns({"reset": F.lit(False), "gone": F.lit(False)})
            .unionByName(removed.withColumns({"reset": F.lit(True), "gone": F.lit(True)}), allowMissingColumns=True))


def current_ledger(spark: SparkSession, ledger_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The ledger after the last committed sync (or `base` before the first)."""
    table = ledger_table(spark, ledger_dir)
    if table.state()[0]:
        return table.read().select(*LEDGER_COLUMNS)
    if base is None:
        raise FileNotFoundError(f"no ledger in {ledger_dir}")
    return base.select(*LEDGER_COLUMNS)


def _beside(spark: SparkSession, ledger_dir: str, name: str, schema) -> DataFrame:
    """Rows of a table beside the ledger whose sync is committed."""
    return read_or_empty(spark, f"{ledger_dir}/{name}", schema).join(ledger_table(spark, ledger_dir).committed(), "sync", "left_semi")


def quarantined(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """All feed rows of unknown accounts so far, with the sync that met them."""
    return _beside(spark, ledger_dir, "quarantine", QUARANTINE)


def applied_files(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """Feed files whose changes are in the ledger."""
    return _beside(spark, ledger_dir, "files", FILES).select("file").distinct()


def synced_accounts(spark: SparkSession, ledger_dir: str, accounts: DataFrame) -> DataFrame:
    """Accounts with the cursor that the last sync of their feed reached; those with one are idle again."""
    done = (_beside(spark, ledger_dir, "cursors", CURSORS)
            .groupBy("external_account_id").agg(F.max("cursor").cast("string").alias("_cursor")))
    return (accounts.join(done, "external_account_id", "left")
            .withColumn("sync_cursor", F.coalesce("_cursor", "sync_cursor"))
            .withColumn("sync_status", F.when(F.col("_cursor").isNotNull(), "IDLE").otherwise(F.col("sync_status")))
            .select(*accounts.columns))


def unapplied(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """The rows of a micro-batch, written, without those of files in `applied`. Only names of the batch's own files are compared,
    and broadcast: joined by file, all rows of one file would meet in one task."""
    landed = cut_lineage(batch)
    known = cut_lineage(applied.select("file").join(landed.select("file").distinct(), "file", "left_semi").distinct())
    return landed.join(F.broadcast(known), "file", "left_anti")


def apply_files(spark: SparkSession, ledger_dir: str, batch: DataFrame, accounts: DataFrame, base: DataFrame | None = None) -> int:
    """One sync: FEED_SCHEMA rows with the `file` that each came from; rows of applied files are left out.
    How many rows were written to the ledger."""
    table = ledger_table(spark, ledger_dir)
    written = 0
    if not table.state()[0] and base is not None:
        written += table.commit(base.select(*LEDGER_COLUMNS).withColumns({"reset": F.lit(False), "gone": F.lit(False)}))
    changes = unapplied(batch, applied_files(spark, ledger_dir))
    if changes.isEmpty():
        return written
    name = uuid.uuid4().hex
    _, orphans = quarantine_orphans(changes, accounts)
    mark = F.lit(name).alias("sync")
    orphans.select(*FEED_SCHEMA.fieldNames(), mark).write.mode("append").parquet(f"{ledger_dir}/quarantine")
    (changes.groupBy("external_account_id").agg(F.max("seq").alias("cursor")).select("*", mark)
     .write.mode("append").parquet(f"{ledger_dir}/cursors"))
    changes.select("file", mark).distinct().write.mode("append").parquet(f"{ledger_dir}/files")
    return written + table.commit(net_entries(changes, accounts), name)


def incremental_sync(spark: SparkSession, feed_dir: str, ledger_dir: str, checkpoint: str,
                     accounts: DataFrame, base: DataFrame | None = None, files_per_sync: int | None = None) -> DataFrame:
    """Run every available feed file through the sync and return the ledger.

    files_per_sync splits a backlog into several syncs; removals then come after the upserts of their own sync.
    """
    feed = spark.readStream.schema(FEED_SCHEMA)
    if files_per_sync:
        feed = feed.option("maxFilesPerTrigger", str(files_per_sync))
    rows = feed.parquet(feed_dir).select("*", F.col("_metadata.file_path").alias("file"))
    q = (rows.writeStream.foreachBatch(lambda batch, _: apply_files(spark, ledger_dir, batch, accounts, base))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_ledger(spark, ledger_dir, base)


def vacuum(spark: SparkSession, ledger_dir: str) -> int:
    """Delete runs that the last commit doesn't name; how many went."""
    return ledger_table(spark, ledger_dir).vacuum()


def write_feed(feed: DataFrame, feed_dir: str) -> None:
    """Land change rows as feed files (one sync's worth)."""
    feed.select(*[f.name for f in FEED_SCHEMA.fields]).write.mode("append").parquet(feed_dir)
