"""Readers for the driver tables and the ledger schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("posted_date", T.DateType(), True),
    T.StructField("amount", T.DecimalType(12, 2), True),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("pending", T.BooleanType(), True),
])
LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("external_account_id", T.StringType(), True),
    T.StructField("access_token", T.StringType(), True),
    T.StructField("sync_cursor", T.StringType(), True),
    T.StructField("sync_status", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
