"""Registered queries for A (normalisation), E (recurring) and F (monthly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.functions.categories import canonical_category, is_inflow, sql_canonical_category, sql_is_inflow
from kontor.operators import monthly as M
from kontor.operators import recurring as E
from kontor.operators.causal import ANOMALY_FEATURES
from kontor.operators import reports as R
from kontor.plans.common import CAT_SQL, EV_SQL, catalogue, events, normalised, with_ledgers
from kontor.plans.registry import d10, flat, query, r6
from kontor.plans.sql_blocks import E1, LED, feat_block, feat_select
from kontor.sources.fixtures import CATALOGUE_BRAND_SQL, CATALOGUE_REGION_YEAR_SQL


def flagged_catalogue(spark, sf):
    return E.flag_recurring(normalised(catalogue(spark, sf)))


def features_catalogue(spark, sf):
    # E1 enters F as pre-aggregated recurring sums (no row-level flag join)
    return M.monthly_features(normalised(catalogue(spark, sf)))


def features_events(spark, sf):
    return M.monthly_features(E.flag_recurring(normalised(events(spark, sf))))


FEAT_CAT = with_ledgers(("raw", CAT_SQL)) + ",\n" + LED + ",\n" + E1 + ",\n" + feat_block()
FEAT_EV = with_ledgers(("raw", EV_SQL)) + ",\n" + LED + ",\n" + E1 + ",\n" + feat_block()


# --- A -----------------------------------------------------------------------

@query("normalise_ledger", with_ledgers(("raw", CAT_SQL)) + ",\n" + LED + f"""
SELECT transaction_id, account_id, {d10('posted_date')} AS posted_date, {r6('amount')} AS amount,
       merchant, category, pending, is_inflow, {d10('month')} AS month FROM led""")
def q_normalise_ledger(spark, sf):
    return flat(normalised(catalogue(spark, sf)))


@query("canonical_category", with_ledgers(("raw", CAT_SQL), ("ev", EV_SQL)) + f""",
u AS (SELECT category FROM raw UNION ALL SELECT category FROM ev)
SELECT category AS raw_category, {sql_canonical_category('category')} AS category, count(*) AS rows
FROM u GROUP BY ALL""")
def q_canonical_category(spark, sf):
    u = catalogue(spark, sf).select("category").unionByName(events(spark, sf).select("category"))
    return flat(u.groupBy(F.col("category").alias("raw_category"))
                .agg(F.count(F.lit(1)).alias("rows"))
                .withColumn("category", canonical_category("raw_category")))


@query("is_inflow", with_ledgers(("raw", CAT_SQL), ("ev", EV_SQL)) + f""",
u AS (SELECT {sql_canonical_category('category')} AS category FROM raw
      UNION ALL SELECT {sql_canonical_category('category')} FROM ev)
SELECT category, {sql_is_inflow('category')} AS is_inflow, count(*) AS rows FROM u GROUP BY ALL""")
def q_is_inflow(spark, sf):
    u = (catalogue(spark, sf).select("category").unionByName(events(spark, sf).select("category"))
         .select(canonical_category("category").alias("category")))
    return flat(u.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
                .withColumn("is_inflow", is_inflow("category")))


# --- E -----------------------------------------------------------------------

@query("flag_recurring", with_ledgers(("raw", CAT_SQL)) + ",\n" + LED + ",\n" + E1 + """
SELECT transaction_id, account_id, merchant, is_recurring FROM flagged""")
def q_flag_recurring(spark, sf):
    return flat(flagged_catalogue(spark, sf).select("transaction_id", "account_id", "merchant",
                                                    "is_recurring"))


def _subs_sql(ledger_sql: str) -> str:
    return with_ledgers(("raw", ledger_sql)) + """,
monthly AS (SELECT account_id, merchant, round(amount, 0) AS amount_key,
                   date_trunc('month', posted_date) AS m, min(category) AS category,
                   avg(CAST(amount AS DOUBLE)) AS amount, count(*) AS charges_in_month,
                   min(posted_date) AS first_seen, max(posted_date) AS last_seen
            FROM raw WHERE amount > 0 GROUP BY account_id, merchant, round(amount, 0), date_trunc('month', posted_date)),
totals AS (SELECT account_id, merchant, count(*) AS merchant_charges FROM raw WHERE amount > 0 GROUP BY ALL),
buckets AS (SELECT account_id, merchant, amount_key, min(category) AS category,
                   avg(amount) AS typical_amount, count(*) AS months_seen,
                   sum(charges_in_month) AS total_charges,
                   min(first_seen) AS first_seen, max(last_seen) AS last_seen
            FROM monthly GROUP BY ALL
            HAVING count(*) >= 3 AND sum(charges_in_month) <= count(*) * 1.5),
subs AS (SELECT b.* FROM buckets b JOIN totals t ON b.account_id = t.account_id AND b.merchant = t.merchant
         WHERE b.total_charges >= t.merchant_charges * 0.8
         QUALIFY row_number() OVER (PARTITION BY b.account_id, b.merchant
                                    ORDER BY typical_amount DESC, amount_key ASC) = 1)"""


SUBS_SELECT = f"""
SELECT account_id, merchant, category, {r6('typical_amount')} AS typical_amount, months_seen,
       {d10('first_seen')} AS first_seen, {d10('last_seen')} AS last_seen FROM subs"""


@query("find_subscriptions", _subs_sql(CAT_SQL) + SUBS_SELECT)
def q_find_subscriptions(spark, sf):
    return flat(E.find_subscriptions(catalogue(spark, sf)))


@query("find_subscriptions_brand_merchant", _subs_sql(CATALOGUE_BRAND_SQL) + SUBS_SELECT)
def q_find_subscriptions_brand(spark, sf):
    return flat(E.find_subscriptions(catalogue(spark, sf, "brand_merchant")))


@query("find_subscriptions_region_year", _subs_sql(CATALOGUE_REGION_YEAR_SQL) + SUBS_SELECT)
def q_find_subscriptions_region_year(spark, sf):
    return flat(E.find_subscriptions(catalogue(spark, sf, "region_year")))


@query("recurring_rule_divergence",
       _subs_sql(CAT_SQL) + ",\n" + LED + ",\n" + E1 + """
SELECT f.account_id, f.merchant, count(*) AS recurring_rows,
       """ + r6("sum(CAST(f.amount AS DOUBLE))") + """ AS recurring_amount
FROM flagged f WHERE is_recurring
  AND NOT EXISTS (SELECT 1 FROM subs s WHERE s.account_id = f.account_id AND s.merchant = f.merchant)
GROUP BY f.account_id, f.merchant""")
def q_recurring_rule_divergence(spark, sf):
    return flat(E.recurring_rule_divergence(flagged_catalogue(spark, sf),
                                            E.find_subscriptions(catalogue(spark, sf))))


@query("subscription_totals", _subs_sql(CAT_SQL) + f"""
SELECT account_id, count(*) AS subscriptions,
       {r6('sum(round(CAST(typical_amount AS DECIMAL(20,6)), 2))')} AS monthly_total,
       {r6('sum(round(CAST(typical_amount AS DECIMAL(20,6)), 2)) * 12')} AS annual_total
FROM subs GROUP BY account_id""")
def q_subscription_totals(spark, sf):
    return flat(R.subscription_totals(E.find_subscriptions(catalogue(spark, sf))))


# --- F -----------------------------------------------------------------------

@query("monthly_features", FEAT_CAT + f"""
SELECT account_id, {d10('month')} AS month, {feat_select()} FROM feat""")
def q_monthly_features(spark, sf):
    return flat(features_catalogue(spark, sf))


@query("monthly_features_events", FEAT_EV + f"""
SELECT account_id, {d10('month')} AS month, {feat_select()} FROM feat""")
def q_monthly_features_events(spark, sf):
    return flat(features_events(spark, sf))


@query("month_vector_or_reason", FEAT_CAT + f""",
req AS (SELECT DISTINCT account_id, month FROM led)
SELECT req.account_id, {d10('req.month')} AS month, {feat_select('feat.')},
       CASE WHEN feat.account_id IS NULL THEN 'not enough data' END AS reason
FROM req LEFT JOIN feat ON req.account_id = feat.account_id AND req.month = feat.month""")
def q_month_vector_or_reason(spark, sf):
    led = normalised(catalogue(spark, sf))
    requested = led.select("account_id", "month").distinct()
    return flat(M.month_vector_or_reason(M.monthly_features(E.flag_recurring(led)), requested))


@query("feature_vector", FEAT_CAT + f"""
SELECT account_id, {d10('month')} AS month, CAST({len(M.BEHAVIOUR_FEATURES)} AS BIGINT) AS dims,
       {', '.join(f"{r6(n)} AS at_{i}" for i, n in enumerate(M.BEHAVIOUR_FEATURES))} FROM feat""")
def q_feature_vector(spark, sf):
    """The vector's values by position, so another order of features shows."""
    v = M.feature_vector(features_catalogue(spark, sf))
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    return flat(v.select("account_id", "month", F.size(x).alias("dims"),
                         *[x[i].alias(f"at_{i}") for i in range(len(M.BEHAVIOUR_FEATURES))]))


@query("recurring_spend", FEAT_CAT + f""",
agg AS (SELECT account_id, month, category, sum(amount) AS total FROM raw2 GROUP BY ALL),
outflow AS (SELECT account_id, month, sum(total) AS total_spend FROM agg WHERE total > 0 GROUP BY ALL)
SELECT o.account_id, {d10('o.month')} AS month, {r6('o.total_spend')} AS total_spend,
       {r6('coalesce(round(CAST(o.total_spend AS DECIMAL(18,2)) * CAST(CAST(f.recurring_share AS VARCHAR) AS DECIMAL(19,18)), 2), 0)')} AS recurring_spend
FROM outflow o LEFT JOIN feat f ON o.account_id = f.account_id AND o.month = f.month""".replace(
    "FROM raw2", "FROM (SELECT account_id, CAST(date_trunc('month', posted_date) AS DATE) AS month, category, amount FROM raw) r2"))
def q_recurring_spend(spark, sf):
    return flat(R.recurring_spend(catalogue(spark, sf), features_catalogue(spark, sf)))


@query("feature_summary", FEAT_CAT + "\n" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS feature, {r6(f'avg({n})')} AS mean, {r6(f'stddev_samp({n})')} AS std, "
    f"{r6(f'min({n})')} AS min, {r6(f'max({n})')} AS max FROM feat"
    for i, n in enumerate(M.BEHAVIOUR_FEATURES)))
def q_feature_summary(spark, sf):
    return flat(R.feature_summary(features_catalogue(spark, sf), M.BEHAVIOUR_FEATURES))


AS_OF_CTES = with_ledgers(("raw", CAT_SQL)) + ",\n" + LED + """,
mk AS (SELECT account_id, merchant, round_even(amount, 0) AS amount_key, month,
              count(*) AS n, sum(CAST(amount AS DOUBLE)) AS s,
              sum(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE)) AS q
       FROM led WHERE NOT is_inflow GROUP BY ALL),
win AS (SELECT *, count(*) OVER w AS months, sum(n) OVER w AS nn, sum(s) OVER w AS ss, sum(q) OVER w AS qq
        FROM mk WINDOW w AS (PARTITION BY account_id, merchant, amount_key
                             ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
verdict AS (SELECT account_id, merchant, amount_key, month,
                   months >= 3 AND sqrt(greatest(CASE WHEN nn > 1 THEN (qq - ss * ss / nn) / (nn - 1) ELSE 0.0 END, 0.0))
                       <= 0.05 * greatest(abs(ss / nn), 0.01) AS rec FROM win),
flagged_as_of AS (SELECT l.*, coalesce(v.rec, false) AND NOT l.is_inflow AS is_recurring
FROM led l LEFT JOIN verdict v ON l.account_id = v.account_id AND l.merchant = v.merchant
 AND round_even(l.amount, 0) = v.amount_key AND l.month = v.month)"""
AS_OF_SQL = AS_OF_CTES + """
SELECT transaction_id, account_id, merchant, is_recurring FROM flagged_as_of"""


@query("flag_recurring_as_of", AS_OF_SQL)
def q_flag_recurring_as_of(spark, sf):
    return flat(E.flag_recurring_as_of(normalised(catalogue(spark, sf)))
                .select("transaction_id", "account_id", "merchant", "is_recurring"))


@query("monthly_features_as_of", AS_OF_CTES + "," + feat_block(src="flagged_as_of") + f"""
SELECT account_id, {d10('month')} AS month, {feat_select()} FROM feat""")
def q_monthly_features_as_of(spark, sf):
    from kontor.plans.flows import features_as_of
    return flat(features_as_of(catalogue(spark, sf)))


@query("feature_contract", FEAT_CAT + f"""
SELECT account_id, {d10('month')} AS month, {feat_select()} FROM feat""")
def q_feature_contract(spark, sf):
    from kontor.operators.contracts import feature_contract
    f = features_catalogue(spark, sf)
    # reversed column order in, model order out
    shuffled = f.select("account_id", "month", *reversed(M.BEHAVIOUR_FEATURES))
    return flat(feature_contract(shuffled, M.BEHAVIOUR_FEATURES, ["account_id", "month"]))


ARTIFACTS = [("scaler", 2 * len(M.BEHAVIOUR_FEATURES)), ("centroids", len(M.BEHAVIOUR_FEATURES)),
             ("forest", len(ANOMALY_FEATURES))]


@query("artifact_consistency", " UNION ALL ".join(
    f"SELECT '{part}' AS part, CAST({n} AS BIGINT) AS found, CAST({n} AS BIGINT) AS widest, CAST({n} AS BIGINT) AS expected, "
    "true AS consistent" for part, n in ARTIFACTS))
def q_artifact_consistency(spark, sf):
    """N3 over models that are fitted on the ledgers, stored and read again."""
    import uuid

    from kontor.plans import flows as P
    from kontor.session import ensure_checkpoint_dir
    from kontor.sources import models
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-models/{uuid.uuid4().hex}"
    models.save_archetypes(P.fit_archetypes(features_catalogue(spark, sf), k=6, restarts=1), M.BEHAVIOUR_FEATURES, f"{root}/archetypes")
    models.save_forest(P.fit_forest(normalised(events(spark, sf))), ANOMALY_FEATURES, f"{root}/forest")
    return models.consistency(spark, f"{root}/archetypes", f"{root}/forest")
