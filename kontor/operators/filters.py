"""B: scans, filters and projections.

Every filter is written on stored columns (ranges, equality), so Catalyst
pushes it into the Parquet scan (`PushedFilters`) and prunes row groups by
min/max; month filters use a date range rather than `trunc(date)`, which
would hide the column from pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.scan import global_running
from kontor.operators.ledger import month_of


def _lit_date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


def ledger_range(raw: DataFrame, account_id: int, start, end) -> DataFrame:
    """B1: one account, inclusive date range."""
    return raw.filter((F.col("account_id") == account_id)
                      & F.col("posted_date").between(_lit_date(start), _lit_date(end)))


def ledger_month(raw: DataFrame, account_id: int, month) -> DataFrame:
    """B2: one account, one calendar month (28..31 days), as a pushable range."""
    first = F.trunc(_lit_date(month), "MM")
    return raw.filter((F.col("account_id") == account_id)
                      & (F.col("posted_date") >= first)
                      & (F.col("posted_date") < F.add_months(first, 1)))


def ledger_by_category(raw: DataFrame, category: str) -> DataFrame:
    """Equality on the raw category."""
    return raw.filter(F.col("category") == category)


def ledger_by_id(raw: DataFrame, transaction_id: str) -> DataFrame:
    """Point lookup by external transaction id."""
    return raw.filter(F.col("transaction_id") == transaction_id)


PUBLIC_ACCOUNT_COLUMNS = ["account_id", "name", "external_account_id", "sync_status"]


def public_accounts(accounts: DataFrame, raw: DataFrame) -> DataFrame:
    """Allow-list projection (no credentials) + activity (D3)."""
    from kontor.operators.reports import account_activity
    act = account_activity(accounts, raw)
    return accounts.select(*PUBLIC_ACCOUNT_COLUMNS).join(act, "account_id")


def linked_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts holding an access token."""
    return accounts.filter(F.col("access_token").isNotNull()).select(*PUBLIC_ACCOUNT_COLUMNS)


def active_accounts(raw: DataFrame, min_txns: int = 15) -> DataFrame:
    """Accounts with >= min_txns rows, rank by count desc (ties: id), their
    newest month, and `is_default` for the busiest account."""
    act = (raw.groupBy("account_id")
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.max(month_of("posted_date")).alias("newest_month"))
           .filter(F.col("transaction_count") >= min_txns))
    # global rank over accounts with the distributed scan (no single-task window)
    ranked = global_running(act, [F.desc("transaction_count"), F.asc("account_id")], rank_col="rank")
    return ranked.withColumn("is_default", F.col("rank") == 1)


def history_window(ledger: DataFrame, months: int = 12) -> DataFrame:
    """B9 (batch form): for every account-month M, the ledger of M-(months-1)
    .. M summarised — rows, spend and first/last day — with a range window
    over a month ordinal on pre-aggregated monthly rows (no range join)."""
    m = (ledger.groupBy("account_id", "month")
         .agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("net_amount"),
              F.min("posted_date").alias("first_day"), F.max("posted_date").alias("last_day")))
    ordinal = F.year("month") * 12 + F.month("month")
    w = (Window.partitionBy("account_id").orderBy(ordinal)
         .rangeBetween(-(months - 1), Window.currentRow))
    return m.select("account_id", "month",
                    F.add_months("month", -(months - 1)).alias("window_start"),
                    F.sum("rows").over(w).alias("rows_in_window"),
                    F.sum("net_amount").over(w).alias("net_amount_in_window"),
                    F.min("first_day").over(w).alias("first_day_in_window"))


def archetype_catalogue(names: DataFrame) -> DataFrame:
    """Cluster, name, description, evidence by numeric cluster id."""
    return names.select("cluster", "name", "description", "evidence").orderBy("cluster")
