"""Registered report queries (D) and their DuckDB twins."""

from __future__ import annotations

from kontor.operators import reports as R
from kontor.plans.common import (ACCOUNTS_SQL, CAT_SQL, EV_SQL, accounts, catalogue, events,
                                 normalised, normalised_sql, with_ledgers)
from kontor.plans.registry import d10, flat, query, r6

MONTH = "CAST(date_trunc('month', posted_date) AS DATE)"

D1_CORE = f"""
agg AS (SELECT account_id, {MONTH} AS month, category,
               sum(amount) AS total, count(*) AS txn_count
        FROM raw GROUP BY ALL)"""

POS_CORE = D1_CORE + """,
pos AS (SELECT account_id, month, category, total FROM agg WHERE total > 0)"""


@query("category_summary", with_ledgers(("raw", CAT_SQL)) + "," + D1_CORE + f"""
SELECT account_id, {d10('month')} AS month, category, {r6('total')} AS total, txn_count,
       row_number() OVER (PARTITION BY account_id, month
                          ORDER BY total DESC, category ASC NULLS FIRST) AS rank
FROM agg""")
def q_category_summary(spark, sf):
    return flat(R.category_summary(catalogue(spark, sf)))


@query("account_month_activity", with_ledgers(("raw", CAT_SQL)) + """
SELECT account_id, strftime(posted_date, '%Y-%m') AS month, count(*) AS transaction_count
FROM raw GROUP BY ALL""")
def q_account_month_activity(spark, sf):
    return flat(R.account_month_activity(catalogue(spark, sf)))


@query("account_activity", with_ledgers(("raw", EV_SQL), ("acc", ACCOUNTS_SQL)) + """,
act AS (SELECT account_id, count(*) AS n,
               array_to_string(list_sort(list_distinct(list(strftime(posted_date, '%Y-%m'))), 'DESC'), '|') AS months
        FROM raw GROUP BY account_id)
SELECT acc.account_id, coalesce(act.n, 0) AS transaction_count, coalesce(act.months, '') AS months
FROM acc LEFT JOIN act ON acc.account_id = act.account_id""")
def q_account_activity(spark, sf):
    return flat(R.account_activity(accounts(spark, sf), events(spark, sf)))


TREND_SQL = f"""
endm AS (SELECT max({MONTH}) AS end_month FROM raw),
spine AS (SELECT CAST(end_month - INTERVAL (o) MONTH AS DATE) AS month, o AS months_back
          FROM endm, range(0, 6) t(o)),
accts AS (SELECT DISTINCT account_id FROM raw),
win AS (SELECT raw.* FROM raw, endm
        WHERE posted_date >= end_month - INTERVAL 5 MONTH AND posted_date < end_month + INTERVAL 1 MONTH),
agg AS (SELECT account_id, {MONTH} AS month, category, sum(amount) AS total FROM win GROUP BY ALL),
outflow AS (SELECT account_id, month, sum(total) AS total_spend FROM agg WHERE total > 0 GROUP BY ALL),
trend AS (SELECT a.account_id, s.month, s.months_back, coalesce(o.total_spend, 0) AS total
          FROM accts a CROSS JOIN spine s
          LEFT JOIN outflow o ON o.account_id = a.account_id AND o.month = s.month)"""


@query("spend_trend", with_ledgers(("raw", CAT_SQL)) + "," + TREND_SQL + f"""
SELECT account_id, {d10('month')} AS month, months_back, {r6('total')} AS total FROM trend""")
def q_spend_trend(spark, sf):
    return flat(R.spend_trend(catalogue(spark, sf)))


@query("trend_stats", with_ledgers(("raw", CAT_SQL)) + "," + TREND_SQL + f""",
t AS (SELECT account_id, month, CAST(total AS DOUBLE) AS total FROM trend),
st AS (SELECT account_id,
              max(total) FILTER (WHERE total > 0) AS peak_total,
              arg_min(month, (-total, month)) FILTER (WHERE total > 0) AS peak_month,
              avg(total) FILTER (WHERE total > 0) AS average,
              count(*) FILTER (WHERE total > 0) AS months_with_data
       FROM t GROUP BY account_id)
SELECT t.account_id, {d10('t.month')} AS month, {r6('t.total')} AS total,
       {r6('peak_total')} AS peak_total, {d10('peak_month')} AS peak_month,
       {r6('average')} AS average, months_with_data,
       {r6('''CASE WHEN t.total > 0 THEN greatest(CASE WHEN peak_total > 0 THEN t.total / peak_total * 100 ELSE 0 END, 2.0)
             ELSE CASE WHEN peak_total > 0 THEN t.total / peak_total * 100 ELSE 0 END END''')} AS bar_height
FROM t JOIN st ON t.account_id = st.account_id""")
def q_trend_stats(spark, sf):
    return flat(R.trend_stats(R.spend_trend(catalogue(spark, sf))))


@query("category_shares", with_ledgers(("raw", CAT_SQL)) + "," + POS_CORE + f"""
SELECT account_id, {d10('month')} AS month, category, {r6('total')} AS total,
       {r6('CAST(total AS DOUBLE) / sum(CAST(total AS DOUBLE)) OVER (PARTITION BY account_id, month)')} AS share_of_month,
       {r6('CAST(total AS DOUBLE) / max(CAST(total AS DOUBLE)) OVER (PARTITION BY account_id, month)')} AS share_of_largest,
       row_number() OVER (PARTITION BY account_id, month ORDER BY total DESC, category ASC NULLS FIRST) AS rank
FROM pos""")
def q_category_shares(spark, sf):
    return flat(R.category_shares(catalogue(spark, sf)))


# share rounded HALF_UP to 4 places in exact integer arithmetic on cents
HALF_UP_SHARE = "((CAST(total * 100 AS HUGEINT) * 20000 + CAST(total_spend * 100 AS HUGEINT)) // (2 * CAST(total_spend * 100 AS HUGEINT))) / 10000.0"


@query("top_categories", with_ledgers(("raw", CAT_SQL)) + "," + POS_CORE + f""",
ranked AS (SELECT *, sum(total) OVER (PARTITION BY account_id, month) AS total_spend,
                  row_number() OVER (PARTITION BY account_id, month ORDER BY total DESC, category ASC NULLS FIRST) AS rank
           FROM pos)
SELECT account_id, {d10('month')} AS month, rank, category, {r6('total')} AS amount,
       {r6(HALF_UP_SHARE)} AS share
FROM ranked WHERE rank <= 5""")
def q_top_categories(spark, sf):
    return flat(R.top_categories(catalogue(spark, sf)))


# change = HALF_UP((cur - prev) / prev, 4) as an exact decimal, then * 100 in double
HALF_UP_CHANGE = """(CASE WHEN cur_c >= prev_c
        THEN ((cur_c - prev_c) * 20000 + prev_c) // (2 * prev_c)
        ELSE -(((prev_c - cur_c) * 20000 + prev_c) // (2 * prev_c)) END) / 10000.0"""


@query("category_deltas", with_ledgers(("raw", CAT_SQL)) + "," + POS_CORE + f""",
j AS (SELECT c.account_id, c.month, c.category, c.total, p.total AS prev_total,
             CAST(c.total * 100 AS HUGEINT) AS cur_c, CAST(p.total * 100 AS HUGEINT) AS prev_c
      FROM pos c JOIN pos p ON c.account_id = p.account_id AND c.category = p.category
                          AND c.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)),
ch AS (SELECT *, CAST({HALF_UP_CHANGE} AS DOUBLE) * 100 AS change FROM j)
SELECT account_id, {d10('month')} AS month, category, {r6('total')} AS this_month,
       {r6('prev_total')} AS last_month, {r6('floor(change * 10 + 0.5) / 10.0')} AS percent_change
FROM ch WHERE abs(change) >= 20""")
def q_category_deltas(spark, sf):
    return flat(R.category_deltas(catalogue(spark, sf)))


@query("month_outflow", with_ledgers(("raw", CAT_SQL)) + "," + POS_CORE + f"""
SELECT account_id, {d10('month')} AS month, {r6('sum(total)')} AS total_spend
FROM pos GROUP BY account_id, month""")
def q_month_outflow(spark, sf):
    return flat(R.month_outflow(catalogue(spark, sf)))


@query("rows_by_category", with_ledgers(("raw", CAT_SQL), ("led", normalised_sql("raw"))) + """
SELECT category, count(*) AS rows FROM led GROUP BY category""")
def q_rows_by_category(spark, sf):
    return flat(R.rows_by_category(normalised(catalogue(spark, sf))))
