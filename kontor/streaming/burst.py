"""O1: live same-merchant burst counts (card-testing signal) on a stream.

Counts per (account, merchant, day of the event) are additive, so each micro-batch
commits its own counts as a run (kontor.sources.runs); runs are summed on read and merged as
they grow. No state is held, and a row that arrives days late still counts. A commit names the files it
counted, so a file is counted once, whatever the stream's checkpoint says. The
sum of a day equals the batch feature G12 (`merchant_txns_same_day`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.categories import canonical_category, is_inflow
from kontor.sources.runs import RunTable, by_rows, summed
from kontor.sources.tables import table
from kontor.streaming.sync import FILES, read_or_empty, unapplied

KEYS = ["account_id", "merchant", "day"]
COUNTS = "account_id long, merchant string, day date, merchant_txns_same_day long"


def events_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The driver's `events` parquet as a file stream (schema taken from the file)."""
    schema = table(spark, sf_dir, "events").schema
    # the stream source watches the directory; the glob keeps it to the events files
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(sf_dir.rstrip("/")).select("*", F.col("_metadata.file_path").alias("file"))


def ledger_stream(events: DataFrame) -> DataFrame:
    """Stream form of the events ledger (same rules as the batch fixture) with
    an event-time column `ts` (driver timestamps are NTZ: cast to timestamp)."""
    k = F.get_json_object("props", "$.k").cast("int")
    category = (F.when(F.col("event_type") == "signup", "Income")
                .when(k % 10 == 0, "Rent")
                .when(F.col("event_type") == "view", "Groceries")
                .when(F.col("event_type") == "click", "Coffee")
                .when(F.col("event_type") == "purchase", "GENERAL_MERCHANDISE")
                .when(F.col("event_type") == "error", "BANK_FEES"))
    negate = (F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (k % 7 == 0))
    amount = F.when(negate, -F.col("value")).otherwise(F.col("value")).cast("decimal(12,2)")
    canon = canonical_category(category)
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("long").alias("account_id"),
        F.concat(F.lit("m"), k.cast("string")).alias("merchant"),
        amount.alias("amount"), is_inflow(canon).alias("is_inflow"), "file")


def burst_counts(spend: DataFrame) -> DataFrame:
    """Charges per (account, merchant, day) on spend rows."""
    return (spend.filter(~F.col("is_inflow") & (F.col("amount") > 0))
            .groupBy("account_id", "merchant", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("merchant_txns_same_day")))


def run_burst_counts(spark: SparkSession, sf_dir: str, out_dir: str, checkpoint: str,
                     files_per_batch: int | None = None) -> DataFrame:
    """Drive O1 over the available events and return the counts."""
    counts = counts_table(spark, out_dir)

    def land(batch: DataFrame, batch_id: int) -> None:
        done = read_or_empty(spark, f"{out_dir}/files", FILES).join(counts.committed(), "sync", "left_semi")
        new = unapplied(batch, done)
        if not new.isEmpty():
            name = uuid.uuid4().hex
            new.select("file", F.lit(name).alias("sync")).distinct().write.mode("append").parquet(f"{out_dir}/files")
            counts.commit(burst_counts(by_rows(new, new.count(), ["account_id", "merchant"])), name)

    stream = ledger_stream(events_stream(spark, sf_dir, files_per_batch))
    q = (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return burst_table(spark, out_dir)


def counts_table(spark: SparkSession, out_dir: str) -> RunTable:
    return RunTable(spark, out_dir, COUNTS, KEYS, summed(KEYS, "merchant_txns_same_day"))


def burst_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counts after the last committed batch."""
    return counts_table(spark, out_dir).read()
