"""SQL twins (DuckDB dialect) of the feature operators, as reusable CTE blocks.

Each block assumes the CTE names of the previous one: raw -> led -> keys ->
flagged -> feat; spend -> txf.
"""

from __future__ import annotations

from kontor.functions.categories import DISCRETIONARY, FIXED_CATEGORY
from kontor.operators.monthly import BEHAVIOUR_FEATURES
from kontor.plans.common import normalised_sql

LED = f"led AS ({normalised_sql('raw')})"

def e1_block(led: str = "led", keys: str = "keys", flagged: str = "flagged") -> str:
    return f"""
{keys} AS (SELECT account_id, merchant, round_even(amount, 0) AS amount_key,
                count(DISTINCT month) AS months,
                avg(CAST(amount AS DOUBLE)) AS mean_amount,
                coalesce(stddev_samp(CAST(amount AS DOUBLE)), 0) AS std_amount
         FROM {led} WHERE NOT is_inflow GROUP BY ALL
         HAVING count(DISTINCT month) >= 3
            AND coalesce(stddev_samp(CAST(amount AS DOUBLE)), 0)
                <= 0.05 * greatest(abs(avg(CAST(amount AS DOUBLE))), 0.01)),
{flagged} AS (SELECT l.*, (k.account_id IS NOT NULL) AND NOT l.is_inflow AS is_recurring
            FROM {led} l LEFT JOIN {keys} k
              ON l.account_id = k.account_id AND l.merchant = k.merchant
             AND round_even(l.amount, 0) = k.amount_key)"""


E1 = e1_block()


def _dsum(cond: str) -> str:
    return f"coalesce(CAST(sum(amount) FILTER (WHERE {cond}) AS DOUBLE), 0)"


def feat_block(min_transactions: int = 5, src: str = "flagged", g: str = "g", feat: str = "feat") -> str:
    spend = "NOT is_inflow"
    disc = f"NOT is_inflow AND category <> '{FIXED_CATEGORY}'"
    cats = ",\n".join(f"{_dsum(disc + f' AND category = ' + repr(c))} AS c_{c}" for c in DISCRETIONARY)
    shares = ",\n".join(f"c_{c} / disc AS share_{c}" for c in DISCRETIONARY)
    return f"""
{g} AS (SELECT account_id, month,
             {_dsum(spend)} AS spend, {_dsum(disc)} AS disc,
             {_dsum(f"NOT is_inflow AND category = '{FIXED_CATEGORY}'")} AS fixed,
             -{_dsum('is_inflow')} AS income,
             count(*) FILTER (WHERE {disc}) AS n,
             quantile_cont(CAST(amount AS DOUBLE), 0.25) FILTER (WHERE {disc}) AS q25,
             quantile_cont(CAST(amount AS DOUBLE), 0.5) FILTER (WHERE {disc}) AS q50,
             quantile_cont(CAST(amount AS DOUBLE), 0.75) FILTER (WHERE {disc}) AS q75,
             count(DISTINCT merchant) FILTER (WHERE {disc}) AS merchants,
             {_dsum(disc + ' AND isodow(posted_date) >= 5')} AS weekend,
             {_dsum(disc + ' AND is_recurring')} AS recurring,
             {cats}
      FROM {src} GROUP BY account_id, month),
{feat} AS (SELECT account_id, month,
                CAST(n AS DOUBLE) AS txn_count,
                q50 AS avg_ticket,
                (q75 - q25) / greatest(q50, 1.0) AS ticket_variability,
                merchants / n AS merchant_diversity,
                weekend / disc AS weekend_ratio,
                recurring / disc AS recurring_share,
                fixed / spend AS fixed_share,
                CASE WHEN income > 0 THEN least(spend / income, 3.0) ELSE 1.0 END AS spend_to_income,
                {shares}
         FROM {g} WHERE n >= {min_transactions} AND spend > 0 AND disc > 0)"""


def feat_select(prefix: str = "") -> str:
    from kontor.plans.registry import r6
    return ", ".join(f"{r6(prefix + n)} AS {n}" for n in BEHAVIOUR_FEATURES)


TXF = """
spend AS (SELECT *, CAST(amount AS DOUBLE) AS amt FROM led WHERE NOT is_inflow AND amount > 0),
w AS (SELECT *,
         avg(amt) OVER pc AS c_mean, stddev_samp(amt) OVER pc AS c_std,
         quantile_cont(amt, 0.5) OVER pc AS c_med, count(amt) OVER pc AS c_cnt,
         avg(amt) OVER pa AS a_mean, stddev_samp(amt) OVER pa AS a_std,
         quantile_cont(amt, 0.5) OVER pa AS a_med,
         row_number() OVER (PARTITION BY account_id, merchant ORDER BY posted_date, transaction_id) AS m_rn,
         row_number() OVER (PARTITION BY account_id, category ORDER BY posted_date, transaction_id) AS c_rn,
         row_number() OVER (PARTITION BY account_id ORDER BY posted_date, transaction_id) AS a_rn,
         lag(posted_date) OVER (PARTITION BY account_id ORDER BY posted_date, transaction_id) AS prev_date,
         count(*) OVER (PARTITION BY account_id, merchant, posted_date) AS m_day,
         count(*) OVER (PARTITION BY account_id, posted_date) AS a_day
      FROM spend
      WINDOW pc AS (PARTITION BY account_id, category ORDER BY posted_date, transaction_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             pa AS (PARTITION BY account_id ORDER BY posted_date, transaction_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
txf AS (SELECT transaction_id, account_id, posted_date, month, merchant, category,
         amt AS amount, ln(1 + greatest(amt, 0)) AS amount_log,
         coalesce(CASE WHEN c_std IS NOT NULL THEN (amt - c_mean) / greatest(c_std, 1.0) END,
                  CASE WHEN a_std IS NOT NULL THEN (amt - a_mean) / greatest(a_std, 1.0) END,
                  0.0) AS amount_zscore_in_category,
         coalesce(CASE WHEN c_med IS NOT NULL THEN amt / greatest(c_med, 1.0) END,
                  CASE WHEN a_med IS NOT NULL THEN amt / greatest(a_med, 1.0) END,
                  1.0) AS amount_ratio_to_category_median,
         CAST(m_rn = 1 AS DOUBLE) AS merchant_novelty,
         CAST(m_rn - 1 AS DOUBLE) AS merchant_frequency,
         CAST(isodow(posted_date) >= 6 AS DOUBLE) AS is_weekend,
         CAST(day(posted_date) AS DOUBLE) AS day_of_month,
         coalesce(CAST(posted_date - prev_date AS DOUBLE), 30.0) AS days_since_previous,
         1.0 - (c_rn - 1) / greatest(a_rn - 1, 1) AS category_rarity,
         CAST(m_day AS DOUBLE) AS merchant_txns_same_day,
         CAST(a_day AS DOUBLE) AS account_txns_same_day,
         CAST(c_cnt >= 5 AS BIGINT) AS has_history
      FROM w)"""

# detector scores for J without a model: z-score and ratio detectors,
# truth = event_id % 31 = 0, kind = event_id % 3
SCORED = """
scored AS (SELECT transaction_id, account_id,
              amount_zscore_in_category AS score, amount_ratio_to_category_median AS ratio_score,
              amount_zscore_in_category > 3.0 AS zscore_flag,
              amount_ratio_to_category_median > 3.0 AS ratio_flag,
              CAST(transaction_id AS BIGINT) % 31 = 0 AS truth,
              'kind_' || CAST(CAST(transaction_id AS BIGINT) % 3 AS VARCHAR) AS kind
           FROM txf)"""
