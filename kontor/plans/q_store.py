"""Registered queries for K (score store), D14 and B10."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import clusters as H
from kontor.operators import reports as R
from kontor.operators import store as K
from kontor.operators.monthly import BEHAVIOUR_FEATURES as NAMES
from kontor.operators.monthly import features_from_facts, month_facts, monthly_features
from kontor.plans.common import CAT_SQL, catalogue, events, normalised, normalised_sql
from kontor.plans.q_anomaly import TXF_EV, txf_events
from kontor.plans.q_features import FEAT_CAT, features_catalogue
from kontor.plans.q_models import ASSIGN_SQL, STATS_SQL, Z_SQL, _fixed
from kontor.plans.registry import d10, flat, query, r6
from kontor.plans.sql_blocks import e1_block, feat_block
from kontor.session import cut_lineage
from kontor.sources import feed as FD

VERSION = "kmeans-k6+iforest-c0.02"


def _eid():
    return F.col("transaction_id").cast("bigint")


def _scored_at(offset_days: int = 0):
    secs = F.unix_seconds(F.col("posted_date").cast("timestamp")) + _eid() % 86400 + offset_days * 86400
    return F.timestamp_seconds(secs)


def old_scores(spark, sf):
    t = txf_events(spark, sf)
    z = F.col("amount_zscore_in_category")
    return t.select(F.lit(K.SUBJECT_TRANSACTION).alias("subject_type"), F.col("transaction_id").alias("subject_id"),
                    F.concat(F.lit("v"), (_eid() % 2).cast("string")).alias("model_name"),
                    F.round(z, 4).alias("score"),
                    F.when(z > 3.0, "ANOMALY").otherwise("NORMAL").alias("label"),
                    _scored_at().alias("scored_at"))


def new_scores(spark, sf):
    t = txf_events(spark, sf).filter(_eid() % 3 == 0)
    z = F.col("amount_zscore_in_category") + 0.5
    return t.select(F.lit(K.SUBJECT_TRANSACTION).alias("subject_type"), F.col("transaction_id").alias("subject_id"),
                    F.lit("v0").alias("model_name"), F.round(z, 4).alias("score"),
                    F.when(z > 3.0, "ANOMALY").otherwise("NORMAL").alias("label"),
                    _scored_at(1).alias("scored_at"))


def _scores_sql(where: str, model: str, bump: str, days: int) -> str:
    return f"""SELECT 'TRANSACTION' AS subject_type, transaction_id AS subject_id, {model} AS model_name,
       round(amount_zscore_in_category + {bump}, 4) AS score,
       CASE WHEN amount_zscore_in_category + {bump} > 3.0 THEN 'ANOMALY' ELSE 'NORMAL' END AS label,
       CAST(posted_date AS TIMESTAMP) + to_seconds(CAST(transaction_id AS BIGINT) % 86400 + {days * 86400}) AS scored_at
FROM txf WHERE {where}"""


SCORES = TXF_EV + f""",
old AS ({_scores_sql('true', "'v' || CAST(CAST(transaction_id AS BIGINT) % 2 AS VARCHAR)", '0.0', 0)}),
new AS ({_scores_sql('CAST(transaction_id AS BIGINT) % 3 = 0', "'v0'", '0.5', 1)}),
ups AS (SELECT * FROM old WHERE (subject_type, subject_id, model_name) NOT IN
            (SELECT (subject_type, subject_id, model_name) FROM new)
        UNION ALL SELECT * FROM new)"""
TS = "strftime(scored_at, '%Y-%m-%d %H:%M:%S')"


@query("upsert_scores", SCORES + f"""
SELECT subject_type, subject_id, model_name, {r6('score')} AS score, label, {TS} AS scored_at FROM ups""")
def q_upsert_scores(spark, sf):
    return flat(K.upsert_scores(old_scores(spark, sf), new_scores(spark, sf)))


@query("latest_score", SCORES + f""",
l AS (SELECT subject_type, subject_id,
             arg_max({{'model_name': model_name, 'score': score, 'label': label, 'scored_at': scored_at}},
                     (scored_at, model_name)) AS s
      FROM ups GROUP BY ALL)
SELECT subject_type, subject_id, s.model_name AS model_name, {r6('s.score')} AS score, s.label AS label,
       strftime(s.scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at FROM l""")
def q_latest_score(spark, sf):
    return flat(K.latest_score(K.upsert_scores(old_scores(spark, sf), new_scores(spark, sf))))


def _scan(spark, sf):
    t = txf_events(spark, sf)
    return t.select("transaction_id", "account_id",
                    F.round("amount_zscore_in_category", 4).alias("anomaly_score"),
                    (F.col("amount_zscore_in_category") > 3.0).alias("is_anomaly"))


MATCH = TXF_EV + f""",
base AS ({FD.BASE_SQL}),
sc AS (SELECT transaction_id, round(amount_zscore_in_category, 4) AS anomaly_score,
              amount_zscore_in_category > 3.0 AS is_anomaly,
              CASE WHEN amount_zscore_in_category > 3.0 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM txf)"""


@query("match_scores_by_id", MATCH + f"""
SELECT sc.transaction_id, b.account_id, {r6('anomaly_score')} AS anomaly_score, is_anomaly, label
FROM sc JOIN base b ON sc.transaction_id = b.transaction_id""")
def q_match_scores_by_id(spark, sf):
    matched, _ = K.match_scores_by_id(_scan(spark, sf), FD.base_ledger(spark, sf))
    return flat(matched.select("transaction_id", "account_id", "anomaly_score", "is_anomaly", "label"))


@query("match_scores_unknown", MATCH + f"""
SELECT transaction_id, {r6('anomaly_score')} AS anomaly_score, label FROM sc
WHERE transaction_id NOT IN (SELECT transaction_id FROM base)""")
def q_match_scores_unknown(spark, sf):
    _, unknown = K.match_scores_by_id(_scan(spark, sf), FD.base_ledger(spark, sf))
    return flat(unknown.select("transaction_id", "anomaly_score", "label"))


FLAGGED = SCORES + """,
fl AS (SELECT u.*, led.account_id, led.posted_date, led.month, led.merchant, led.amount
       FROM ups u JOIN led ON u.subject_id = led.transaction_id
       WHERE u.subject_type = 'TRANSACTION' AND u.label = 'ANOMALY'),
rk AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, subject_id ASC, model_name ASC) AS rank
       FROM fl)"""


def _flagged(spark, sf):
    raw = normalised(events(spark, sf))
    return K.flagged_transactions(K.upsert_scores(old_scores(spark, sf), new_scores(spark, sf)), raw)


@query("flagged_transactions", FLAGGED + f"""
SELECT subject_id AS transaction_id, account_id, model_name, {r6('score')} AS score, rank FROM rk""")
def q_flagged_transactions(spark, sf):
    return flat(_flagged(spark, sf).select("transaction_id", "account_id", "model_name", "score", "rank"))


@query("flagged_in_month", FLAGGED + f""",
m AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, subject_id ASC, model_name ASC) AS r2
      FROM rk WHERE month = (SELECT max(month) FROM led))
SELECT subject_id AS transaction_id, account_id, {r6('score')} AS score, r2 AS rank FROM m""")
def q_flagged_in_month(spark, sf):
    raw = normalised(events(spark, sf))
    month = raw.agg(F.max("month")).scalar()
    scores = K.upsert_scores(old_scores(spark, sf), new_scores(spark, sf))
    fl = R.flagged_in_month(K.flagged_rows(scores, raw.filter(F.col("month") == month)), month)
    return flat(fl.select("transaction_id", "account_id", "score", "rank"))


@query("anomaly_scan_summary", TXF_EV + f"""
SELECT account_id, '{VERSION}' AS model_version, count(*) AS scored,
       count(*) FILTER (WHERE amount_zscore_in_category > 3.0) AS flagged,
       {r6('count(*) FILTER (WHERE amount_zscore_in_category > 3.0) / count(*)')} AS flagged_fraction
FROM txf GROUP BY account_id""")
def q_anomaly_scan_summary(spark, sf):
    s = _scan(spark, sf).withColumn("model_version", F.lit(VERSION))
    return flat(R.anomaly_scan_summary(s))


# --- K1 / K6 over account-months ---------------------------------------------------

def new_features(spark, sf):
    """A recomputation on settled rows only (pending excluded) for even accounts."""
    led = normalised(catalogue(spark, sf)).filter(~F.col("pending") & (F.col("account_id") % 2 == 0))
    return monthly_features(led)


def _upsert_features_sql() -> str:
    new_part = (f"rawn AS (SELECT * FROM ({CAT_SQL}) c WHERE NOT pending AND account_id % 2 = 0),\n"
                + f"ledn AS ({normalised_sql('rawn')}),\n"
                + e1_block("ledn", "keysn", "flaggedn") + ",\n"
                + feat_block(src="flaggedn", g="gn", feat="featn"))
    return FEAT_CAT + ",\n" + new_part + f""",
ups AS (SELECT * FROM feat WHERE (account_id, month) NOT IN (SELECT (account_id, month) FROM featn)
        UNION ALL SELECT * FROM featn)
SELECT account_id, {d10('month')} AS month, """ + ", ".join(f"{r6(n)} AS {n}" for n in NAMES) + " FROM ups"


@query("upsert_features", _upsert_features_sql())
def q_upsert_features(spark, sf):
    return flat(K.upsert_features(features_catalogue(spark, sf), new_features(spark, sf)))


def _fallback(spark, sf):
    facts = cut_lineage(month_facts(normalised(catalogue(spark, sf))))  # features, requests and windows: one ledger read
    feats = cut_lineage(features_from_facts(facts))
    stats = cut_lineage(H.fit_scaler(feats))
    assigned = H.assign_cluster(H.standardise(feats, stats), _fixed(spark))
    label = F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))
    live = assigned.filter(F.col("account_id") % 3 != 0).select(
        "account_id", "month", label.alias("label"), F.col("distance_to_centroid").alias("score"),
        F.lit(VERSION).alias("model_name"))
    stored = assigned.filter(F.col("month") < F.lit("1998-01-01").cast("date")).select(
        "account_id", "month", label.alias("label"), F.col("distance_to_centroid").alias("score"),
        F.lit("stored-v1").alias("model_name"),
        F.add_months("month", 1).cast("timestamp").alias("scored_at"))
    # every account-month, and for each account one two years after its last: nothing in that window
    counts = cut_lineage(facts.groupBy("account_id", "month").agg(F.sum("n").alias("rows")))
    late = counts.groupBy("account_id").agg(F.add_months(F.max("month"), 24).alias("month"))
    requested = (counts.select("account_id", "month").unionByName(late)
                 .withColumn("service_up", F.col("account_id") % 3 != 0))
    return K.scores_with_fallback(K.with_counts(requested, counts), feats, live, stored)


@query("scores_with_fallback", FEAT_CAT + ",\n" + STATS_SQL + ",\n" + Z_SQL + ",\n" + ASSIGN_SQL + f""",
req AS (SELECT DISTINCT account_id, month FROM led
        UNION ALL SELECT account_id, CAST(max(month) + INTERVAL 24 MONTH AS DATE) FROM led GROUP BY account_id),
win AS (SELECT r.account_id, r.month, count(l.account_id) AS n FROM req r LEFT JOIN led l
          ON l.account_id = r.account_id AND l.posted_date >= r.month - INTERVAL 11 MONTH
         AND l.posted_date < r.month + INTERVAL 1 MONTH GROUP BY ALL),
j AS (SELECT win.account_id, win.month, n > 0 AS known, win.account_id % 3 <> 0 AS up,
             feat.account_id IS NOT NULL AS has_feat, win.month < DATE '1998-01-01' AS has_stored,
             asg.cluster, round(asg.dist, 3) AS dist
      FROM win LEFT JOIN feat ON win.account_id = feat.account_id AND win.month = feat.month
               LEFT JOIN asg ON win.account_id = asg.account_id AND win.month = asg.month)
SELECT account_id, {d10('month')} AS month,
       CASE WHEN known AND has_feat AND (up OR has_stored) THEN 'cluster-' || CAST(cluster AS VARCHAR) END AS archetype,
       CASE WHEN known AND NOT up AND has_feat AND has_stored THEN '{K.NOTE_STALE}' END AS description,
       {r6("CASE WHEN known AND has_feat AND (up OR has_stored) THEN dist END")} AS score,
       CASE WHEN NOT known OR NOT has_feat THEN NULL WHEN up THEN '{VERSION}' WHEN has_stored THEN 'stored-v1' END AS model_name,
       known AND NOT up AS stale,
       CASE WHEN NOT known THEN '{K.NOTE_NO_TRANSACTIONS}'
            WHEN up THEN CASE WHEN NOT has_feat THEN '{K.NOTE_THIN}' END
            WHEN has_feat AND has_stored
              THEN 'Last scored ' || strftime(CAST(month + INTERVAL 1 MONTH AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')
            ELSE '{K.NOTE_NONE}' END AS note
FROM j""")
def q_scores_with_fallback(spark, sf):
    return flat(_fallback(spark, sf))


SCAN_SQL = FLAGGED + """,
today AS (SELECT max(posted_date) AS d FROM raw),
req AS (SELECT DISTINCT account_id FROM raw UNION ALL SELECT DISTINCT -account_id - 1 FROM raw),
live AS (SELECT account_id, count(*) AS scored, count(*) FILTER (WHERE amount_zscore_in_category > 3.0) AS flagged
         FROM txf WHERE account_id % 5 <> 1 GROUP BY account_id),
held AS (SELECT account_id, count(*) AS n FROM fl GROUP BY account_id),
rec AS (SELECT account_id, count(*) AS n FROM raw, today
        WHERE posted_date BETWEEN d - INTERVAL 24 MONTH AND d + INTERVAL 1 DAY GROUP BY account_id),
j AS (SELECT q.account_id, rec.n IS NOT NULL AS known, q.account_id % 3 <> 0 AS up, live.scored, live.flagged, held.n AS held
      FROM req q LEFT JOIN rec ON q.account_id = rec.account_id LEFT JOIN live ON q.account_id = live.account_id
      LEFT JOIN held ON q.account_id = held.account_id)
SELECT account_id, CASE WHEN known AND up THEN coalesce(scored, 0) ELSE 0 END AS scored,
       CASE WHEN NOT known THEN 0 WHEN up THEN coalesce(flagged, 0) ELSE coalesce(held, 0) END AS flagged,
       CASE WHEN known AND up AND scored IS NOT NULL THEN '""" + VERSION + """' END AS model_version, known AND NOT up AS stale,
       CASE WHEN NOT known THEN '""" + K.NOTE_NO_TRANSACTIONS + """' WHEN NOT up THEN '""" + K.NOTE_STALE_FLAGS + """'
            WHEN scored IS NULL THEN '""" + K.NOTE_NOTHING_SCORABLE + """' END AS note FROM j"""


@query("scan_with_fallback", SCAN_SQL)
def q_scan_with_fallback(spark, sf):
    """The transaction half of K6: service down for every third account, nothing scorable for some, and accounts
    without any transaction."""
    raw = normalised(events(spark, sf))
    ids = raw.select("account_id").distinct()
    requested = ids.unionByName(ids.select((-F.col("account_id") - 1).alias("account_id"))) \
        .withColumn("service_up", F.col("account_id") % 3 != 0)
    live = _scan(spark, sf).filter("account_id % 5 <> 1").withColumn("model_version", F.lit(VERSION))
    stored = K.flagged_rows(K.upsert_scores(old_scores(spark, sf), new_scores(spark, sf)), raw)
    return K.scan_with_fallback(requested, raw, live, stored, raw.agg(F.max("posted_date")).scalar())
