"""Registered queries for A1, A5, A7-A10 (files, JSON, validation) and B (filters)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kontor.operators import filters as B
from kontor.operators.ledger import pack_features, unpack_feature, validate_ledger, validate_months
from kontor.operators.monthly import BEHAVIOUR_FEATURES as NAMES
from kontor.plans.common import (ACCOUNTS_SQL, CAT_SQL, EV_SQL, accounts, catalogue, events,
                                 normalised, with_ledgers)
from kontor.plans.q_features import FEAT_CAT, features_catalogue
from kontor.plans.registry import d10, flat, query, r6
from kontor.session import ensure_checkpoint_dir
from kontor.sources import files as FS
from kontor.plans.sql_blocks import LED
from kontor.plans.q_advice import NAMES_SQL
from kontor.plans.q_models import BASE_ASG


def _scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-files/{what}-{uuid.uuid4().hex}"


LEDGER_OUT = f"""SELECT transaction_id, account_id, {d10('posted_date')} AS posted_date, {r6('amount')} AS amount,
       merchant, category, pending"""


@query("read_ledger_csv", "WITH e AS (" + EV_SQL + ") " + LEDGER_OUT + " FROM e")
def q_read_ledger_csv(spark, sf):
    """Round trip: the events ledger written as CSV (A5), read back by A1 with a
    missing path in the list (skipped)."""
    path = _scratch(spark, "ledger-csv")
    FS.write_ledger_csv(events(spark, sf), path)
    return flat(FS.read_ledger_csv(spark, [path, path + "-missing"]))


@query("write_ledger_csv", "WITH c0 AS (" + CAT_SQL + """),
c AS (SELECT * REPLACE (CASE account_id % 5 WHEN 0 THEN merchant || ', Inc.' WHEN 1 THEN '"' || merchant || '"'
                             WHEN 2 THEN merchant || chr(10) || 'next line' WHEN 3 THEN NULL ELSE merchant END AS merchant) FROM c0) """
       + LEDGER_OUT + " FROM c")
def q_write_ledger_csv(spark, sf):
    """The catalogue ledger (categories with spaces; merchants with commas, quotes, line breaks and
    nulls) written and read back: every value survives the CSV rules."""
    path = _scratch(spark, "catalogue-csv")
    m, rest = F.col("merchant"), F.col("account_id") % 5
    odd = (F.when(rest == 0, F.concat(m, F.lit(", Inc."))).when(rest == 1, F.concat(F.lit('"'), m, F.lit('"')))
           .when(rest == 2, F.concat(m, F.lit("\nnext line"))).when(rest == 4, m))
    FS.write_ledger_csv(catalogue(spark, sf).withColumn("merchant", odd), path)
    return flat(FS.read_ledger_csv(spark, [path]))


@query("pack_features", FEAT_CAT + f"""
SELECT account_id, {d10('month')} AS month, {', '.join(f"{r6(n)} AS {n}" for n in NAMES)},
       CAST(0.0 AS DOUBLE) AS missing_feature FROM feat""")
def q_pack_features(spark, sf):
    packed = pack_features(features_catalogue(spark, sf), NAMES, ["account_id", "month"])
    return flat(packed.select("account_id", "month",
                              *[unpack_feature("features", n).alias(n) for n in NAMES],
                              unpack_feature("features", "no_such_feature").alias("missing_feature")))


@query("write_monthly_features", FEAT_CAT + "\nSELECT account_id, " + d10("month") + " AS month, "
       + ", ".join(f"{r6(n)} AS {n}" for n in NAMES) + " FROM feat")
def q_write_monthly_features(spark, sf):
    path = _scratch(spark, "features")
    FS.write_monthly_features(features_catalogue(spark, sf), path)
    return flat(FS.read_monthly_features(spark, path).select("account_id", "month", *NAMES))


@query("write_labelled_months", BASE_ASG + ",\n" + NAMES_SQL + f"""
SELECT account_id, {d10('month')} AS month, CAST(asg.cluster AS BIGINT) AS cluster, archetype
FROM asg JOIN names ON asg.cluster = names.cluster""")
def q_write_labelled_months(spark, sf):
    from kontor.operators import clusters as H
    from kontor.plans.q_models import _fixed, assigned_catalogue
    a, _ = assigned_catalogue(spark, sf)
    path = _scratch(spark, "labelled")
    FS.write_labelled_months(a, H.name_clusters(_fixed(spark)), path)
    back = spark.read.parquet(path)
    return flat(back.withColumn("cluster", F.col("cluster").cast("long")))


def _text_ledger(spark, sf):
    e = events(spark, sf)
    eid = F.col("transaction_id").cast("bigint")
    return e.select(
        F.when(eid % 83 == 0, F.lit("")).otherwise(F.col("transaction_id")).alias("transaction_id"),
        F.col("account_id").cast("string").alias("account_id"),
        F.when(eid % 97 == 0, F.date_format("posted_date", "yyyy/MM/dd"))
         .otherwise(F.date_format("posted_date", "yyyy-MM-dd")).alias("posted_date"),
        F.when(eid % 89 == 0, F.lit("n/a")).when(eid % 79 == 0, F.lit("99999999999.99"))
         .otherwise(F.col("amount").cast("string")).alias("amount"),
        "merchant", "category",
        F.when(eid % 73 == 0, F.lit("maybe")).otherwise(F.col("pending").cast("string")).alias("pending"),
        eid.alias("event_id"))


TEXT_SQL = f"""
t AS (SELECT CASE WHEN eid % 83 = 0 THEN '' ELSE transaction_id END AS transaction_id,
             CAST(account_id AS VARCHAR) AS account_id,
             CASE WHEN eid % 97 = 0 THEN strftime(posted_date, '%Y/%m/%d') ELSE strftime(posted_date, '%Y-%m-%d') END AS posted_date,
             CASE WHEN eid % 89 = 0 THEN 'n/a' WHEN eid % 79 = 0 THEN '99999999999.99' ELSE CAST(amount AS VARCHAR) END AS amount,
             CASE WHEN eid % 73 = 0 THEN 'maybe' ELSE CAST(pending AS VARCHAR) END AS pending,
             merchant, category, eid AS event_id
      FROM (SELECT *, CAST(transaction_id AS BIGINT) AS eid FROM ({EV_SQL}) e0) e),
v AS (SELECT *, CASE WHEN transaction_id IS NULL OR trim(transaction_id) = '' THEN 'missing transaction_id'
                     WHEN TRY_CAST(account_id AS BIGINT) IS NULL THEN 'bad account_id'
                     WHEN posted_date IS NULL OR NOT regexp_matches(posted_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                          OR TRY_CAST(posted_date AS DATE) IS NULL THEN 'bad posted_date'
                     WHEN TRY_CAST(amount AS DECIMAL(12,2)) IS NULL THEN 'bad amount'
                     WHEN merchant IS NULL THEN 'missing merchant'
                     WHEN category IS NULL THEN 'missing category'
                     WHEN pending IS NOT NULL AND TRY_CAST(pending AS BOOLEAN) IS NULL THEN 'bad pending' END AS reason FROM t)"""


@query("validate_ledger", "WITH " + TEXT_SQL + """
SELECT event_id, reason FROM v WHERE reason IS NOT NULL""")
def q_validate_ledger(spark, sf):
    _, bad = validate_ledger(_text_ledger(spark, sf))
    return bad.select("event_id", "reason")


@query("validate_ledger_good", "WITH " + TEXT_SQL + f"""
SELECT transaction_id, CAST(account_id AS BIGINT) AS account_id, posted_date,
       {r6('CAST(amount AS DECIMAL(12,2))')} AS amount, CAST(pending AS BOOLEAN) AS pending FROM v WHERE reason IS NULL""")
def q_validate_ledger_good(spark, sf):
    good, _ = validate_ledger(_text_ledger(spark, sf))
    return flat(good.select("transaction_id", "account_id", "posted_date", "amount", "pending"))


MONTHS_SQL = "WITH e AS (" + EV_SQL + """),
r AS (SELECT DISTINCT account_id, CASE account_id % 7 WHEN 0 THEN strftime(posted_date, '%Y/%m') WHEN 1 THEN strftime(posted_date, '%Y') || '-13'
                                    ELSE strftime(posted_date, '%Y-%m') END AS month FROM e)
SELECT account_id, month, CASE WHEN account_id % 7 < 2 THEN 'bad month' END AS reason FROM r"""


@query("validate_months", MONTHS_SQL)
def q_validate_months(spark, sf):
    """Month requests of every account, some with another separator or no such month: good ones and quarantine together."""
    day, rest = F.col("posted_date"), F.col("account_id") % 7
    requests = events(spark, sf).select("account_id", F.when(rest == 0, F.date_format(day, "yyyy/MM"))
                                        .when(rest == 1, F.concat(F.date_format(day, "yyyy"), F.lit("-13")))
                                        .otherwise(F.date_format(day, "yyyy-MM")).alias("month")).distinct()
    good, bad = validate_months(requests)
    return (good.select("account_id", F.date_format("month", "yyyy-MM").alias("month"), F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("account_id", "month", "reason")))


# --- B -----------------------------------------------------------------------

@query("ledger_range", "WITH c AS (" + CAT_SQL + ") " + LEDGER_OUT
       + " FROM c WHERE account_id = 7 AND posted_date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def q_ledger_range(spark, sf):
    return flat(B.ledger_range(catalogue(spark, sf), 7, "1996-01-01", "1996-06-30"))


@query("ledger_month", "WITH c AS (" + CAT_SQL + ") " + LEDGER_OUT
       + " FROM c WHERE account_id = 7 AND posted_date >= DATE '1997-02-01' AND posted_date < DATE '1997-03-01'")
def q_ledger_month(spark, sf):
    return flat(B.ledger_month(catalogue(spark, sf), 7, "1997-02-14"))


@query("ledger_by_category", "WITH c AS (" + CAT_SQL + ") " + LEDGER_OUT + " FROM c WHERE category = ' Coffee '")
def q_ledger_by_category(spark, sf):
    return flat(B.ledger_by_category(catalogue(spark, sf), " Coffee "))


ONE_ID = f"{268:019d}"


@query("ledger_by_id", "WITH e AS (" + EV_SQL + ") " + LEDGER_OUT + f" FROM e WHERE transaction_id = '{ONE_ID}'")
def q_ledger_by_id(spark, sf):
    return flat(B.ledger_by_id(events(spark, sf), ONE_ID))


@query("public_accounts", with_ledgers(("raw", EV_SQL), ("acc", ACCOUNTS_SQL)) + """,
act AS (SELECT account_id, count(*) AS n,
               array_to_string(list_sort(list_distinct(list(strftime(posted_date, '%Y-%m'))), 'DESC'), '|') AS months
        FROM raw GROUP BY account_id)
SELECT acc.account_id, name, external_account_id, sync_status,
       coalesce(act.n, 0) AS transaction_count, coalesce(act.months, '') AS months
FROM acc LEFT JOIN act ON acc.account_id = act.account_id""")
def q_public_accounts(spark, sf):
    return flat(B.public_accounts(accounts(spark, sf), events(spark, sf)))


@query("linked_accounts", "WITH acc AS (" + ACCOUNTS_SQL + """)
SELECT account_id, name, external_account_id, sync_status FROM acc WHERE access_token IS NOT NULL""")
def q_linked_accounts(spark, sf):
    return B.linked_accounts(accounts(spark, sf))


@query("active_accounts", "WITH raw AS (" + EV_SQL + """),
a AS (SELECT account_id, count(*) AS transaction_count, max(CAST(date_trunc('month', posted_date) AS DATE)) AS newest_month
      FROM raw GROUP BY account_id HAVING count(*) >= 15),
r AS (SELECT *, row_number() OVER (ORDER BY transaction_count DESC, account_id ASC) AS rank FROM a)
SELECT account_id, transaction_count, strftime(newest_month, '%Y-%m-%d') AS newest_month, rank, rank = 1 AS is_default FROM r""")
def q_active_accounts(spark, sf):
    return flat(B.active_accounts(events(spark, sf), 15).select(
        "account_id", "transaction_count", "newest_month", "rank", "is_default"))


@query("history_window", with_ledgers(("raw", CAT_SQL)) + ",\n" + LED + f""",
m AS (SELECT account_id, month, count(*) AS n_rows, sum(amount) AS net, min(posted_date) AS first_day FROM led GROUP BY ALL),
w AS (SELECT m1.account_id, m1.month, sum(m2.n_rows) AS rows_in_window, sum(m2.net) AS net_amount_in_window,
             min(m2.first_day) AS first_day_in_window
      FROM m m1 JOIN m m2 ON m1.account_id = m2.account_id
       AND m2.month BETWEEN CAST(m1.month - INTERVAL 11 MONTH AS DATE) AND m1.month
      GROUP BY m1.account_id, m1.month)
SELECT account_id, {d10('month')} AS month, {d10("month - INTERVAL 11 MONTH")} AS window_start,
       CAST(rows_in_window AS BIGINT) AS rows_in_window, {r6('net_amount_in_window')} AS net_amount_in_window,
       {d10('first_day_in_window')} AS first_day_in_window FROM w""")
def q_history_window(spark, sf):
    return flat(B.history_window(normalised(catalogue(spark, sf)), 12))
