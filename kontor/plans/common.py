"""Shared inputs for registered queries: ledgers and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.categories import sql_canonical_category, sql_is_inflow
from kontor.operators.ledger import normalise_ledger
from kontor.sources import fixtures
from kontor.sources.tables import table


def catalogue(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    return fixtures.catalogue_ledger(spark, sf_dir, variant)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events_ledger(spark, sf_dir)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account dimension derived from `customer` (most have no events rows).

    Every fourth customer has no access token (unlinked).
    """
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("account_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("ext-"), F.col("c_custkey").cast("string")).alias("external_account_id"),
        F.when(F.col("c_custkey") % 4 != 0,
               F.concat(F.lit("tok-"), F.col("c_custkey").cast("string"))).alias("access_token"),
        F.lit(None).cast("string").alias("sync_cursor"),
        F.lit("IDLE").alias("sync_status"),
    )


ACCOUNTS_SQL = """
SELECT CAST(c_custkey AS BIGINT) AS account_id, c_name AS name,
       'ext-' || CAST(c_custkey AS VARCHAR) AS external_account_id,
       CASE WHEN c_custkey % 4 <> 0 THEN 'tok-' || CAST(c_custkey AS VARCHAR) END AS access_token,
       CAST(NULL AS VARCHAR) AS sync_cursor, 'IDLE' AS sync_status
FROM customer
"""


def normalised(raw: DataFrame) -> DataFrame:
    return normalise_ledger(raw)


def normalised_sql(raw_cte: str) -> str:
    """SQL twin of A2 over a CTE named `raw_cte`."""
    cat = sql_canonical_category("category")
    return f"""
SELECT transaction_id, account_id, posted_date, amount, merchant, canon AS category, pending,
       {sql_is_inflow('canon')} AS is_inflow,
       CAST(date_trunc('month', posted_date) AS DATE) AS month
FROM (SELECT *, {cat} AS canon FROM {raw_cte}) n
"""


CAT_SQL = fixtures.CATALOGUE_LEDGER_SQL
EV_SQL = fixtures.EVENTS_LEDGER_SQL


def with_ledgers(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes)
