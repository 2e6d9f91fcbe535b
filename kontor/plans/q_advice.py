"""Registered queries for L (advice) over the catalogue ledger.

Flagged charges come from a rule-made score store: score = first 32 bits of
md5(transaction_id) / 2^32, label ANOMALY when score > 0.998 (derived from the
data, so it grows with it, and reproducible in SQL). Archetypes come from the
rule-made centroid table named by H7.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import advice as L
from kontor.operators import clusters as H
from kontor.operators import refresh
from kontor.operators import reports as R
from kontor.operators.ledger import month_of
from kontor.operators.monthly import BEHAVIOUR_FEATURES as NAMES
from kontor.operators.monthly import category_totals, features_from_facts, month_facts
from kontor.plans.common import catalogue
from kontor.plans.q_models import ASSIGN_SQL, BASE, _fixed
from kontor.plans.q_reports import HALF_UP_CHANGE, HALF_UP_SHARE
from kontor.plans.registry import flat, query, r6
from kontor.session import cut_lineage

FLAG_CUTOFF = 0.998


def hash_scores(raw):
    u = F.conv(F.substring(F.md5("transaction_id"), 1, 8), 16, 10).cast("double") / 4294967296.0
    return raw.select("transaction_id", "account_id", "posted_date", "merchant", "amount",
                      F.round(u, 4).alias("anomaly_score"), (u > FLAG_CUTOFF).alias("is_anomaly"))


# The names that the rule-made centroids get, by cluster.
FIXED_NAMES = ["High Txn Count", "High Recurring Share", "Low Merchant Diversity", "High Avg Ticket", "High Fixed Costs", "Commuter"]


def _fixed_description(cluster: int) -> str:
    """A rule-made centroid has one feature at +1 and one at -1; equal sizes keep the feature order."""
    high, low = (5 * cluster) % len(NAMES), (5 * cluster + 7) % len(NAMES)
    return "This group " + ", ".join(H.PHRASES[NAMES[i]][i == low] for i in sorted((high, low))) + "."


def inputs_catalogue(spark, sf):
    raw = cut_lineage(catalogue(spark, sf))  # the facts and the scores below are read from it
    facts = cut_lineage(month_facts(raw))  # F and every D report below ride on this one table
    feats = cut_lineage(features_from_facts(facts))
    totals = cut_lineage(category_totals(facts))
    stats = H.fit_scaler(feats)
    cents = _fixed(spark)
    assigned = H.assign_cluster(H.standardise(feats, stats), cents)
    names = H.name_clusters(cents).select("cluster", F.col("name").alias("archetype"), "description")
    arche = assigned.join(F.broadcast(names), "cluster").select("account_id", "month", "archetype", "description")
    months = totals.select("account_id", "month").distinct()
    flagged = hash_scores(raw).filter("is_anomaly").withColumn("month", month_of("posted_date"))
    return L.advice_inputs(months, arche, R.top_categories(None, totals=totals), R.category_deltas(None, totals=totals), flagged,
                           R.month_outflow(None, totals), R.recurring_spend(None, feats, totals))


def advice_catalogue(spark, sf):
    return L.generate_advice(inputs_catalogue(spark, sf))


# --- SQL twin of the inputs ----------------------------------------------------

NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(
    f"({c}, '{n}', '{_fixed_description(c)}')" for c, n in enumerate(FIXED_NAMES)) + ") t(cluster, archetype, description))"
MONEY = "('$' || CAST(CAST(round(CAST({x} AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) AS VARCHAR))"
PCT = "(CAST(CAST(floor(({x}) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%')"


def money(x: str) -> str:
    return MONEY.format(x=x)


def pct(x: str) -> str:
    return PCT.format(x=x)


INPUTS_SQL = BASE + ",\n" + ASSIGN_SQL + ",\n" + NAMES_SQL + f""",
arche AS (SELECT asg.account_id, asg.month, names.archetype, names.description FROM asg JOIN names ON asg.cluster = names.cluster),
months AS (SELECT DISTINCT account_id, CAST(date_trunc('month', posted_date) AS DATE) AS month FROM raw),
agg AS (SELECT account_id, CAST(date_trunc('month', posted_date) AS DATE) AS month, category,
               sum(amount) AS total FROM raw GROUP BY ALL),
pos AS (SELECT * FROM agg WHERE total > 0),
ranked AS (SELECT *, sum(total) OVER (PARTITION BY account_id, month) AS total_spend,
                  row_number() OVER (PARTITION BY account_id, month ORDER BY total DESC, category ASC NULLS FIRST) AS rank
           FROM pos),
top AS (SELECT account_id, month,
               list({{'category': category, 'amount': CAST(total AS DECIMAL(38,2)),
                     'share': CAST({HALF_UP_SHARE} AS DOUBLE)}} ORDER BY rank) AS top_categories
        FROM ranked WHERE rank <= 5 GROUP BY account_id, month),
dj AS (SELECT c.account_id, c.month, c.category, c.total, p.total AS prev_total,
              CAST(c.total * 100 AS HUGEINT) AS cur_c, CAST(p.total * 100 AS HUGEINT) AS prev_c
       FROM pos c JOIN pos p ON c.account_id = p.account_id AND c.category = p.category
                            AND c.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)),
dch AS (SELECT *, CAST({HALF_UP_CHANGE} AS DOUBLE) * 100 AS change FROM dj),
deltas AS (SELECT account_id, month,
                  list({{'category': category, 'this_month': CAST(total AS DECIMAL(38,2)),
                        'last_month': CAST(prev_total AS DECIMAL(38,2)),
                        'percent_change': floor(change * 10 + 0.5) / 10.0}}
                       ORDER BY total DESC, category ASC) AS notable_changes
           FROM dch WHERE abs(change) >= 20 GROUP BY account_id, month),
hs AS (SELECT transaction_id, account_id, posted_date, merchant, amount,
              ('0x' || substr(md5(transaction_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM raw),
fl AS (SELECT *, round(u, 4) AS score, CAST(date_trunc('month', posted_date) AS DATE) AS month
       FROM hs WHERE u > {FLAG_CUTOFF}),
flags AS (SELECT account_id, month, count(*) AS flagged_count,
                 arg_min({{'merchant': merchant, 'amount': CAST(amount AS DECIMAL(38,2)),
                          'date': strftime(posted_date, '%Y-%m-%d'),
                          'reason': 'its anomaly score of '
                                    || CAST(CAST(round(CAST(score AS DECIMAL(38,6)), 3) AS DECIMAL(38,3)) AS VARCHAR)
                                    || ' is well above the flagging threshold'}},
                         (-CAST(amount AS DECIMAL(38,2)), -score, transaction_id)) AS top_flagged,
                 sum(('0x' || substr(md5(concat_ws('|', transaction_id, merchant, CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR),
                     strftime(posted_date, '%Y-%m-%d'),
                     CAST(CAST(round(CAST(score AS DECIMAL(38,6)), 3) AS DECIMAL(38,3)) AS VARCHAR))), 1, 8))::BIGINT) AS flagged_digest
          FROM fl GROUP BY account_id, month),
outflow AS (SELECT account_id, month, sum(total) AS total_spend FROM pos GROUP BY ALL),
recur AS (SELECT o.account_id, o.month,
                 coalesce(round(CAST(o.total_spend AS DECIMAL(18,2)) * CAST(CAST(f.recurring_share AS VARCHAR) AS DECIMAL(19,18)), 2), 0) AS recurring_spend
          FROM outflow o LEFT JOIN feat f ON o.account_id = f.account_id AND o.month = f.month),
inputs AS (SELECT m.account_id, m.month, a.archetype, a.description, coalesce(fg.flagged_digest, 0) AS flagged_digest,
                  coalesce(t.top_categories, []) AS top_categories,
                  coalesce(d.notable_changes, []) AS notable_changes,
                  coalesce(fg.flagged_count, 0) AS flagged_count, fg.top_flagged,
                  coalesce(CAST(o.total_spend AS DECIMAL(38,2)), 0) AS total_spend,
                  coalesce(CAST(r.recurring_spend AS DECIMAL(38,2)), 0) AS recurring_spend
           FROM months m
           LEFT JOIN arche a ON m.account_id = a.account_id AND m.month = a.month
           LEFT JOIN top t ON m.account_id = t.account_id AND m.month = t.month
           LEFT JOIN deltas d ON m.account_id = d.account_id AND m.month = d.month
           LEFT JOIN flags fg ON m.account_id = fg.account_id AND m.month = fg.month
           LEFT JOIN outflow o ON m.account_id = o.account_id AND m.month = o.month
           LEFT JOIN recur r ON m.account_id = r.account_id AND m.month = r.month)"""

KEY_OUT = "account_id, strftime(month, '%Y-%m-%d') AS month"

TEXT_FIELDS = {
    "month_text": "strftime(month, '%Y-%m')", "archetype": "coalesce(archetype, '')",
    "archetype_description": "coalesce(description, '')",
    "top_categories": """array_to_string(list_transform(top_categories, lambda c: concat_ws(':', c.category,
        CAST(c.amount AS VARCHAR), printf('%.4f', c.share))), ';')""",
    "notable_changes": """array_to_string(list_transform(notable_changes, lambda d: concat_ws(':', d.category,
        CAST(d.this_month AS VARCHAR), CAST(d.last_month AS VARCHAR), printf('%.1f', d.percent_change))), ';')""",
    "flagged_count": "CAST(flagged_count AS VARCHAR)",
    "top_flagged": """CASE WHEN top_flagged IS NULL THEN '' ELSE concat_ws(':', top_flagged.merchant,
        CAST(top_flagged.amount AS VARCHAR), top_flagged.date, top_flagged.reason) END""",
    "flagged_digest": "CAST(flagged_digest AS VARCHAR)",
    "total_spend": "CAST(CAST(total_spend AS DECIMAL(38,2)) AS VARCHAR)",
    "recurring_spend": "CAST(CAST(recurring_spend AS DECIMAL(38,2)) AS VARCHAR)",
}
ENOUGH = "(archetype IS NOT NULL AND len(top_categories) > 0)"


@query("has_enough_data", INPUTS_SQL + f"""
SELECT {KEY_OUT}, archetype IS NOT NULL AND len(top_categories) > 0 AS has_enough_data,
       CASE WHEN archetype IS NOT NULL AND len(top_categories) > 0 THEN 'rules' ELSE 'none' END AS source
FROM inputs""")
def q_has_enough_data(spark, sf):
    return flat(L.has_enough_data(inputs_catalogue(spark, sf))
                .select("account_id", "month", "has_enough_data", "source"))


SUMMARY_SQL = f"""'Your spending this month looks like a ' || coalesce(lower(archetype), 'typical') || ' pattern'
    || CASE WHEN len(top_categories) > 0 THEN ', led by ' || top_categories[1].category || ' at '
            || {pct('top_categories[1].share')} || ' of your discretionary spending' ELSE '' END
    || '. ' || CASE WHEN flagged_count = 0 THEN '{L.NOTHING_FLAGGED}'
                    ELSE CAST(flagged_count AS VARCHAR)
                         || CASE WHEN flagged_count = 1 THEN ' charge was' ELSE ' charges were' END
                         || ' flagged as unusual.' END"""


@query("rule_summary", INPUTS_SQL + f"""
SELECT {KEY_OUT}, {SUMMARY_SQL} AS summary FROM inputs""")
def q_rule_summary(spark, sf):
    return flat(L.rule_summary(inputs_catalogue(spark, sf)).select("account_id", "month", "summary"))


def _filler_sql() -> str:
    items = ", ".join(f"{{'title': '{t}', 'detail': '{d}', 'saving': 0.0}}" for t, d in L.FILLERS)
    return f"[{items}]"


_REC_SHARE = "((CAST(recurring_spend * 100 AS HUGEINT) * 20000 + CAST(total_spend * 100 AS HUGEINT)) // (2 * CAST(total_spend * 100 AS HUGEINT))) / 10000.0"

RECS_SQL = f"""list_slice(list_concat(
    list_filter(list_transform(top_categories, lambda c: CASE WHEN c.share >= {L.HIGH_CATEGORY_SHARE} THEN
        {{'title': 'Trim ' || c.category || ' spending',
          'detail': c.category || ' was ' || {pct('c.share')} || ' of your discretionary spending ('
                    || {money('c.amount')} || '). Cutting it by 15% would free about '
                    || {money('round(c.amount * 0.15, 2)')} || ' a month.',
          'saving': CAST(round(c.amount * 0.15, 2) AS DOUBLE)}} END), lambda x: x IS NOT NULL),
    list_filter(list_transform(notable_changes, lambda d: CASE WHEN d.percent_change >= {L.NOTABLE_INCREASE} THEN
        {{'title': 'Check your rising ' || d.category || ' costs',
          'detail': d.category || ' rose ' || CAST(CAST(floor(d.percent_change + 0.5) AS BIGINT) AS VARCHAR)
                    || '% from ' || {money('d.last_month')} || ' to ' || {money('d.this_month')}
                    || '. Returning to last month''s level would save '
                    || {money('round(d.this_month - d.last_month, 2)')} || '.',
          'saving': CAST(round(d.this_month - d.last_month, 2) AS DOUBLE)}} END), lambda x: x IS NOT NULL),
    CASE WHEN total_spend > 0 AND {_REC_SHARE} >= {L.HIGH_RECURRING_SHARE} THEN
        [{{'title': 'Audit your recurring charges',
           'detail': {money('recurring_spend')} || ' of your spending is recurring subscriptions — '
                     || {pct(_REC_SHARE)} || ' of the total. Cancelling the ones you no longer use is the easiest saving available to you.',
           'saving': CAST(round(recurring_spend * 0.25, 2) AS DOUBLE)}}] ELSE [] END,
    {_filler_sql()}), 1, 3)"""


@query("rule_recommendations", INPUTS_SQL + f""",
recs AS (SELECT account_id, month, {RECS_SQL} AS r FROM inputs)
SELECT {KEY_OUT}, len(r) AS n_recommendations,
       array_to_string(list_transform(r, lambda x: x.title), '|') AS titles,
       array_to_string(list_transform(r, lambda x: x.detail), '|') AS details,
       {r6('r[1].saving')} AS saving_1, {r6('r[2].saving')} AS saving_2, {r6('r[3].saving')} AS saving_3
FROM recs""")
def q_rule_recommendations(spark, sf):
    a = L.rule_recommendations(inputs_catalogue(spark, sf))
    r = F.col("recommendations")
    return flat(a.select("account_id", "month", F.size(r).cast("long").alias("n_recommendations"),
                         F.array_join(F.transform(r, lambda x: x["title"]), "|").alias("titles"),
                         F.array_join(F.transform(r, lambda x: x["detail"]), "|").alias("details"),
                         r[0]["saving"].alias("saving_1"), r[1]["saving"].alias("saving_2"),
                         r[2]["saving"].alias("saving_3")))


@query("explain_top_flag", INPUTS_SQL + f"""
SELECT {KEY_OUT},
       CASE WHEN flagged_count = 0 THEN '{L.NOTHING_UNUSUAL}'
            ELSE 'The ' || {money('top_flagged.amount')} || ' charge at ' || top_flagged.merchant || ' on '
                 || top_flagged.date || ' was flagged because ' || lower(top_flagged.reason) || '.' END
         AS flagged_charge_explanation
FROM inputs""")
def q_explain_top_flag(spark, sf):
    return flat(L.explain_top_flag(inputs_catalogue(spark, sf))
                .select("account_id", "month", "flagged_charge_explanation"))


@query("advice_valid", INPUTS_SQL + f"""
SELECT {KEY_OUT}, account_id % 5 NOT IN (1, 2, 3) AND length(trim({SUMMARY_SQL})) > 0 AND len({RECS_SQL}) = 3 AS valid
FROM inputs""")
def q_advice_valid(spark, sf):
    """Advice of which some is broken by rule: a blank summary, a missing recommendation, a blank detail."""
    a = advice_catalogue(spark, sf).drop("valid")
    recs, rest = F.col("recommendations"), F.col("account_id") % 5
    a = (a.withColumn("summary", F.when(rest == 1, F.lit(" \t\n")).otherwise(F.col("summary")))
         .withColumn("recommendations", F.when(rest == 2, F.slice(recs, 1, 2)).when(rest == 3, F.transform(
             recs, lambda r: r.withField("detail", F.lit("\u2003")))).otherwise(recs)))
    return flat(L.advice_valid(a).select("account_id", "month", "valid"))


@query("advice_inputs", INPUTS_SQL + f"""
SELECT {KEY_OUT}, {', '.join(f"{sql} AS {name}" for name, sql in TEXT_FIELDS.items())} FROM inputs""")
def q_advice_inputs(spark, sf):
    """Every input by value, as the text that L3 hashes."""
    i = inputs_catalogue(spark, sf)
    return i.select("account_id", F.date_format("month", "yyyy-MM-dd").alias("month"),
                    *[c.alias(name) for name, c in L.inputs_text().items()])


@query("advice_flagged_charges", INPUTS_SQL + f"""
SELECT {KEY_OUT}, transaction_id, merchant, {r6('amount')} AS amount, strftime(posted_date, '%Y-%m-%d') AS date,
       CAST(CAST(round(CAST(score AS DECIMAL(38,6)), 3) AS DECIMAL(38,3)) AS VARCHAR) AS score FROM fl""")
def q_advice_flagged_charges(spark, sf):
    """The companion list of L1: every flagged charge of every account-month."""
    flagged = hash_scores(catalogue(spark, sf)).filter("is_anomaly").withColumn("month", month_of("posted_date"))
    return flat(L.flagged_charges(flagged).select("account_id", "month", "transaction_id", "merchant", "amount", "date", "score"))


@query("inputs_hash", INPUTS_SQL + f"""
SELECT {KEY_OUT}, sha256(concat_ws('|', {', '.join(TEXT_FIELDS.values())})) AS inputs_hash FROM inputs""")
def q_inputs_hash(spark, sf):
    return flat(L.inputs_hash(inputs_catalogue(spark, sf)).select("account_id", "month", "inputs_hash"))


def _refresh(inputs):
    hashed = L.inputs_hash(L.has_enough_data(inputs))
    # a cache written before the last change: odd accounts saw no flagged charges
    before = inputs.withColumn("flagged_count", F.when(F.col("account_id") % 2 == 1, F.lit(0).cast("long"))
                               .otherwise(F.col("flagged_count")))
    cache = L.inputs_hash(L.has_enough_data(before)).filter("has_enough_data") \
        .select("account_id", "month", "inputs_hash", "source")
    return L.advice_refresh_set(hashed, cache)


CACHED_SQL = f"({ENOUGH} AND (account_id % 2 <> 1 OR flagged_count = 0))"


@query("advice_refresh_set", INPUTS_SQL + f"""
SELECT {KEY_OUT}, {CACHED_SQL} AS cached, NOT {CACHED_SQL} AS regenerate FROM inputs""")
def q_advice_refresh_set(spark, sf):
    return flat(_refresh(cut_lineage(inputs_catalogue(spark, sf))).select("account_id", "month", "cached", "regenerate"))


# --- L4 after a change: rows whose id hashes to 000... are the ones that have just arrived ------------

ARRIVED = "substr(md5(transaction_id), 1, 3) = '000'"
_SPEND_KEY = "SELECT account_id, merchant, round_even(amount, 0) AS amount_key FROM led WHERE NOT is_inflow"
REACHED_SQL = f"""
fresh AS (SELECT * FROM led WHERE {ARRIVED}),
reached AS (SELECT account_id, month FROM fresh
            UNION SELECT account_id, CAST(month + INTERVAL 1 MONTH AS DATE) FROM fresh
            UNION SELECT l.account_id, l.month FROM led l
                  JOIN ({_SPEND_KEY} AND {ARRIVED} GROUP BY ALL) k
                    ON l.account_id = k.account_id AND l.merchant = k.merchant AND round_even(l.amount, 0) = k.amount_key
                  WHERE NOT l.is_inflow)"""


@query("advice_refresh_reached", INPUTS_SQL + "," + REACHED_SQL + f"""
SELECT {KEY_OUT}, {ENOUGH} AS has_enough_data, sha256(concat_ws('|', {', '.join(TEXT_FIELDS.values())})) AS inputs_hash
FROM inputs SEMI JOIN reached USING (account_id, month)""")
def q_advice_refresh_reached(spark, sf):
    """The months that the arrived rows reach, recomputed from their own rows; the twin recomputes everything."""
    raw = cut_lineage(catalogue(spark, sf))  # a stored ledger: its joins run once
    facts = cut_lineage(month_facts(raw))
    reached = cut_lineage(refresh.reached_months(raw, raw.filter(ARRIVED), facts=facts))
    cents = _fixed(spark)
    # the stored scaler
    stats = cut_lineage(H.fit_scaler(features_from_facts(facts)))
    model = refresh.ArchetypeModel(stats, cents, H.name_clusters(cents))
    flagged = hash_scores(raw).filter("is_anomaly").withColumn("month", month_of("posted_date"))
    inputs = refresh.reached_inputs(raw, reached, flagged, model, facts=facts)
    return flat(L.inputs_hash(L.has_enough_data(inputs)).select("account_id", "month", "has_enough_data", "inputs_hash"))


@query("advice_provenance", INPUTS_SQL + f"""
SELECT {KEY_OUT}, CASE WHEN {ENOUGH} THEN 'rules' ELSE 'none' END AS source, {CACHED_SQL} AS cached FROM inputs""")
def q_advice_provenance(spark, sf):
    inputs = cut_lineage(inputs_catalogue(spark, sf))
    return flat(L.advice_provenance(L.generate_advice(inputs), _refresh(inputs)))


@query("archetype_catalogue")
def q_archetype_catalogue(spark, sf):
    from kontor.operators.filters import archetype_catalogue
    from kontor.plans.q_models import lloyd_centroids
    cents, _ = lloyd_centroids(spark, sf)
    names = H.name_clusters(cents)
    return archetype_catalogue(names).select(
        "cluster", "name", "description",
        F.array_join(F.transform("evidence", lambda e: e["feature"]), "|").alias("evidence"))
