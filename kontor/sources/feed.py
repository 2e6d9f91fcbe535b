"""Change feed, accounts and stored scores derived from `events` (for M and K).

base      = events ledger rows with event_id % 5 <> 0
added     = the rest (event_id % 5 = 0)
modified  = event_id % 7 = 0, amount + 1
removed   = event_id % 11 = 0
page      = event_id % 3, seq = event_id
orphans   = accounts with user_id % 13 = 0 are absent from the account table
Feed columns are blanked by rule so every A6 fallback is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.sources.fixtures import EVENTS_LEDGER_SQL, events_ledger



def _eid():
    return F.col("transaction_id").cast("bigint")


def base_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir).filter(_eid() % 5 != 0)


def feed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_ledger(spark, sf_dir).select("account_id").distinct()
    return ev.filter(F.col("account_id") % 13 != 0).select(
        F.col("account_id"),
        F.concat(F.lit("user-"), F.col("account_id").cast("string")).alias("name"),
        F.concat(F.lit("ext-"), F.col("account_id").cast("string")).alias("external_account_id"),
        F.concat(F.lit("tok-"), F.col("account_id").cast("string")).alias("access_token"),
        F.lit(None).cast("string").alias("sync_cursor"),
        F.lit("IDLE").alias("sync_status"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = events_ledger(spark, sf_dir).withColumn("_eid", _eid())

    def rows(kind: str, cond, bump: float = 0.0) -> DataFrame:
        eid = F.col("_eid")
        return led.filter(cond).select(
            "transaction_id",
            F.concat(F.lit("ext-"), F.col("account_id").cast("string")).alias("external_account_id"),
            F.col("posted_date").alias("date"),
            (F.col("amount").cast("double") + F.lit(bump)).alias("amount"),
            F.when(eid % 17 == 0, F.lit("")).when(eid % 31 == 0, F.lit("\t")).otherwise(F.col("merchant")).alias("merchant_name"),
            F.when(eid % 19 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("name-"), F.col("merchant"))).alias("name"),
            F.when(eid % 23 == 0, F.lit(None).cast("boolean")).otherwise(F.col("pending")).alias("pending"),
            F.when(eid % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("primary_category"),
            F.lit(kind).alias("kind"), (eid % 3).cast("int").alias("page"), eid.alias("seq"))

    eid = F.col("_eid")
    return (rows("added", eid % 5 == 0)
            .unionByName(rows("modified", eid % 7 == 0, 1.0))
            .unionByName(rows("removed", eid % 11 == 0)))


BASE_SQL = f"SELECT * FROM ({EVENTS_LEDGER_SQL}) b WHERE CAST(transaction_id AS BIGINT) % 5 <> 0"

ACCOUNTS_SQL = f"""
SELECT DISTINCT account_id, 'user-' || CAST(account_id AS VARCHAR) AS name,
       'ext-' || CAST(account_id AS VARCHAR) AS external_account_id,
       'tok-' || CAST(account_id AS VARCHAR) AS access_token,
       CAST(NULL AS VARCHAR) AS sync_cursor, 'IDLE' AS sync_status
FROM ({EVENTS_LEDGER_SQL}) e WHERE account_id % 13 <> 0
"""


def _rows_sql(kind: str, cond: str, bump: str = "0.0") -> str:
    return f"""
SELECT transaction_id, 'ext-' || CAST(account_id AS VARCHAR) AS external_account_id,
       posted_date AS date, CAST(amount AS DOUBLE) + {bump} AS amount,
       CASE WHEN eid % 17 = 0 THEN '' WHEN eid % 31 = 0 THEN chr(9) ELSE merchant END AS merchant_name,
       CASE WHEN eid % 19 = 0 THEN NULL ELSE 'name-' || merchant END AS name,
       CASE WHEN eid % 23 = 0 THEN NULL ELSE pending END AS pending,
       CASE WHEN eid % 29 = 0 THEN NULL ELSE category END AS primary_category,
       '{kind}' AS kind, CAST(eid % 3 AS INTEGER) AS page, eid AS seq
FROM (SELECT *, CAST(transaction_id AS BIGINT) AS eid FROM ({EVENTS_LEDGER_SQL}) e0) e
WHERE {cond}"""


FEED_SQL = (_rows_sql("added", "eid % 5 = 0") + "\nUNION ALL" + _rows_sql("modified", "eid % 7 = 0", "1.0")
            + "\nUNION ALL" + _rows_sql("removed", "eid % 11 = 0"))
