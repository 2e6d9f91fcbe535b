"""M: change feed -> ledger (batch form; the streaming form is in kontor.streaming).

Change rows: transaction_id, external_account_id, date, amount, merchant_name,
name, pending, primary_category, kind ('added' | 'modified' | 'removed'),
page, seq. Sync order is (page, added before modified, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators.ledger import feed_value
from kontor.sources.tables import LEDGER_COLUMNS

def kind_order():
    """added (0) before modified (1) before removed (2) inside a page."""
    return F.when(F.col("kind") == "added", 0).when(F.col("kind") == "modified", 1).otherwise(2)
VALUE_COLUMNS = ["posted_date", "amount", "merchant", "category", "pending"]


def quarantine_orphans(changes: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: (rows of known accounts with the local account_id, orphan rows)."""
    ext = accounts.select("external_account_id", "account_id").filter(F.col("external_account_id").isNotNull())
    upserts = changes.filter(F.col("kind") != "removed")
    ok = upserts.join(ext, "external_account_id")
    orphans = upserts.join(ext, "external_account_id", "left_anti")
    return ok, orphans


def apply_changes(base: DataFrame, changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """M1: added/modified are upserts by transaction_id, last write wins in
    sync order; an update keeps the stored account_id, an insert takes the
    account of the first event that created it. Orphan rows are skipped."""
    ok, _ = quarantine_orphans(changes, accounts)
    # stored rows and events are one stream per id, stored rows first: the first names the
    # account, the last the values (A6 applied to each event), in one shuffle
    order = lambda stored, page, kind, seq: F.struct(
        F.lit(stored).alias("fed"), page.cast("int").alias("page"), kind.cast("int").alias("k"), seq.cast("long").alias("seq")).alias("_order")
    old = base.select("transaction_id", F.col("account_id").cast("long").alias("account_id"),
                      order(0, F.lit(0), F.lit(0), F.lit(0)), F.struct(*VALUE_COLUMNS).alias("_v"))
    ev = ok.select("transaction_id", F.col("account_id").cast("long").alias("account_id"),
                   order(1, F.col("page"), kind_order(), F.col("seq")), F.struct(*_value_exprs()).alias("_v"))
    merged = old.unionByName(ev).groupBy("transaction_id").agg(
        F.max_by("_v", "_order").alias("_v"), F.min_by("account_id", "_order").alias("account_id"))
    return merged.select("transaction_id", "account_id", "_v.*").select(*LEDGER_COLUMNS)


def _value_exprs():
    return [feed_value(c) for c in VALUE_COLUMNS]


def apply_removals(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """M2: removals of the whole sync applied after all upserts."""
    removed = changes.filter(F.col("kind") == "removed").select("transaction_id").distinct()
    return ledger.join(removed, "transaction_id", "left_anti")


def sync(base: DataFrame, changes: DataFrame, accounts: DataFrame) -> DataFrame:
    return apply_removals(apply_changes(base, changes, accounts), changes)


def sync_counts(base: DataFrame, changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """M3: added = real inserts; modified = every modified event (skipped ones
    too); removed = rows actually deleted; pages, counted for each item (external account)."""
    ok, _ = quarantine_orphans(changes, accounts)
    first = (ok.groupBy("transaction_id")
             .agg(F.min_by("kind", F.struct("page", kind_order().alias("k"), "seq")).alias("first_kind")))
    inserts = (first.filter(F.col("first_kind") == "added")
               .join(base.select("transaction_id"), "transaction_id", "left_anti"))
    after = apply_changes(base, changes, accounts).select("transaction_id")
    removed_ids = changes.filter(F.col("kind") == "removed").select("transaction_id").distinct()
    deleted = removed_ids.join(after, "transaction_id", "left_semi")
    return changes.agg(
        inserts.agg(F.count(F.lit(1))).scalar().alias("added"),
        F.count_if(F.col("kind") == "modified").alias("modified"),
        deleted.agg(F.count(F.lit(1))).scalar().alias("removed"),
        F.countDistinct("external_account_id", "page").alias("pages"))


def link_accounts(accounts: DataFrame, fetched: DataFrame) -> DataFrame:
    """M5: insert fetched external accounts that are absent; new local ids
    continue after the current maximum, in external-id order."""
    from kontor.functions.scan import global_running
    new = (fetched.select("external_account_id", "name").dropDuplicates(["external_account_id"])
           .join(accounts.select("external_account_id"), "external_account_id", "left_anti"))
    start = accounts.agg(F.coalesce(F.max("account_id"), F.lit(0))).scalar()
    ranked = global_running(new, [F.asc("external_account_id")], rank_col="_r")
    added = ranked.select((start + F.col("_r")).cast("long").alias("account_id"), "name",
                          "external_account_id", F.lit(None).cast("string").alias("access_token"),
                          F.lit(None).cast("string").alias("sync_cursor"), F.lit("IDLE").alias("sync_status"))
    return accounts.unionByName(added.select(*accounts.columns))


def sync_progress(accounts: DataFrame, status: str) -> DataFrame:
    """M7: every linked account (token present) moves to `status` in one
    projection; `any_syncing` answers "is a sync running?"."""
    linked = F.col("access_token").isNotNull()
    out = accounts.withColumn("sync_status", F.when(linked, F.lit(status)).otherwise(F.col("sync_status")))
    anyone = out.agg(F.max((F.col("sync_status") == "SYNCING").cast("int")) == 1).scalar()
    return out.withColumn("any_syncing", anyone)
