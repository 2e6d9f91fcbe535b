"""Registered queries for M (change feed) and A6 (feed mapping)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.functions.text import sql_blank_to_null
from kontor.operators import ingest as M
from kontor.operators.ledger import map_feed_record
from kontor.plans.common import ACCOUNTS_SQL as CUSTOMER_ACCOUNTS_SQL
from kontor.plans.common import accounts as customer_accounts
from kontor.plans.registry import d10, flat, query, r6
from kontor.sources import feed as FD

HEAD = f"WITH base AS ({FD.BASE_SQL}), acc AS ({FD.ACCOUNTS_SQL}), feed AS ({FD.FEED_SQL})"

MAPPED = """
mapped AS (SELECT transaction_id, external_account_id, kind, page, seq,
                  date AS posted_date, TRY_CAST(CAST(amount AS VARCHAR) AS DECIMAL(12,2)) AS amount,
                  coalesce(""" + sql_blank_to_null("merchant_name") + ", " + sql_blank_to_null("name") + """, 'Unknown') AS merchant,
                  coalesce(primary_category, 'OTHER') AS category,
                  coalesce(pending, false) AS pending
           FROM feed)"""

APPLY = MAPPED + """,
ok AS (SELECT m.*, a.account_id FROM mapped m JOIN acc a ON m.external_account_id = a.external_account_id
       WHERE m.kind <> 'removed'),
ev AS (SELECT *, CASE kind WHEN 'added' THEN 0 WHEN 'modified' THEN 1 ELSE 2 END AS k FROM ok),
per AS (SELECT transaction_id,
               arg_max({'posted_date': posted_date, 'amount': amount, 'merchant': merchant,
                        'category': category, 'pending': pending}, (page, k, seq)) AS v,
               arg_min(account_id, (page, k, seq)) AS first_acc,
               arg_min(kind, (page, k, seq)) AS first_kind
        FROM ev GROUP BY transaction_id),
changed AS (SELECT p.transaction_id, CAST(coalesce(b.account_id, p.first_acc) AS BIGINT) AS account_id,
                   v.posted_date AS posted_date, v.amount AS amount, v.merchant AS merchant,
                   v.category AS category, v.pending AS pending
            FROM per p LEFT JOIN base b ON p.transaction_id = b.transaction_id),
applied AS (SELECT transaction_id, account_id, posted_date, amount, merchant, category, pending FROM base
            WHERE transaction_id NOT IN (SELECT transaction_id FROM per)
            UNION ALL SELECT * FROM changed),
removed AS (SELECT DISTINCT transaction_id FROM feed WHERE kind = 'removed'),
synced AS (SELECT * FROM applied WHERE transaction_id NOT IN (SELECT transaction_id FROM removed))"""

LEDGER_OUT = f"""SELECT transaction_id, account_id, {d10('posted_date')} AS posted_date, {r6('amount')} AS amount,
       merchant, category, pending"""


def _base(spark, sf):
    return FD.base_ledger(spark, sf), FD.change_feed(spark, sf), FD.feed_accounts(spark, sf)


@query("map_feed_record", HEAD + "," + MAPPED + f"""
SELECT transaction_id, external_account_id, kind, {d10('posted_date')} AS posted_date, {r6('amount')} AS amount,
       merchant, category, pending FROM mapped""")
def q_map_feed_record(spark, sf):
    return flat(map_feed_record(FD.change_feed(spark, sf), keep=["kind"]))


@query("apply_changes", HEAD + "," + APPLY + "\n" + LEDGER_OUT + " FROM applied")
def q_apply_changes(spark, sf):
    base, feed, acc = _base(spark, sf)
    return flat(M.apply_changes(base, feed, acc))


@query("apply_removals", HEAD + "," + APPLY + "\n" + LEDGER_OUT + " FROM synced")
def q_apply_removals(spark, sf):
    base, feed, acc = _base(spark, sf)
    return flat(M.sync(base, feed, acc))


@query("sync_counts", HEAD + "," + APPLY + """
SELECT (SELECT count(*) FROM per WHERE first_kind = 'added'
          AND transaction_id NOT IN (SELECT transaction_id FROM base)) AS added,
       (SELECT count(*) FROM feed WHERE kind = 'modified') AS modified,
       (SELECT count(*) FROM removed WHERE transaction_id IN (SELECT transaction_id FROM applied)) AS removed,
       (SELECT count(DISTINCT (external_account_id, page)) FROM feed) AS pages""")
def q_sync_counts(spark, sf):
    base, feed, acc = _base(spark, sf)
    return flat(M.sync_counts(base, feed, acc))


@query("quarantine_orphans", HEAD + """
SELECT transaction_id, external_account_id, kind FROM feed
WHERE kind <> 'removed' AND external_account_id NOT IN (SELECT external_account_id FROM acc)""")
def q_quarantine_orphans(spark, sf):
    _, feed, acc = _base(spark, sf)
    _, orphans = M.quarantine_orphans(feed, acc)
    return orphans.select("transaction_id", "external_account_id", "kind")


@query("link_accounts", HEAD + """,
fetched AS (SELECT DISTINCT external_account_id, 'user-' || substr(external_account_id, 5) AS name FROM feed),
new AS (SELECT * FROM fetched WHERE external_account_id NOT IN (SELECT external_account_id FROM acc)),
ranked AS (SELECT *, row_number() OVER (ORDER BY external_account_id) AS r FROM new)
SELECT account_id, name, external_account_id, access_token, sync_status FROM acc
UNION ALL
SELECT CAST((SELECT max(account_id) FROM acc) + r AS BIGINT), name, external_account_id, NULL, 'IDLE' FROM ranked""")
def q_link_accounts(spark, sf):
    _, feed, acc = _base(spark, sf)
    fetched = feed.select("external_account_id",
                          F.concat(F.lit("user-"), F.expr("substr(external_account_id, 5)")).alias("name"))
    return M.link_accounts(acc, fetched).select("account_id", "name", "external_account_id",
                                                "access_token", "sync_status")


@query("sync_progress", f"WITH acc AS ({CUSTOMER_ACCOUNTS_SQL})" + """,
upd AS (SELECT account_id, CASE WHEN access_token IS NOT NULL THEN 'SYNCING' ELSE sync_status END AS sync_status
        FROM acc)
SELECT account_id, sync_status, (SELECT max(CAST(sync_status = 'SYNCING' AS INTEGER)) = 1 FROM upd) AS any_syncing
FROM upd""")
def q_sync_progress(spark, sf):
    return M.sync_progress(customer_accounts(spark, sf), "SYNCING").select(
        "account_id", "sync_status", "any_syncing")
