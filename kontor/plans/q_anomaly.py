"""Registered queries for G (causal features), H1/H16, N2 and J (evaluation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import causal as G
from kontor.operators import contracts as N
from kontor.operators import evaluate as J
from kontor.operators import explain as X
from kontor.plans.common import EV_SQL, events, normalised, with_ledgers
from kontor.plans.registry import d10, flat, query, r6
from kontor.plans.sql_blocks import LED, SCORED, TXF
from kontor.session import cut_lineage

BUDGET = 62  # matched flag budget of the published comparison

TXF_EV = with_ledgers(("raw", EV_SQL)) + ",\n" + LED + ",\n" + TXF
SCORED_EV = TXF_EV + ",\n" + SCORED


def txf_events(spark, sf):
    return G.transaction_features(normalised(events(spark, sf)))


def scored_events(spark, sf):
    """Detector scores for J without a model (rule-made truth and kinds)."""
    t = txf_events(spark, sf)
    eid = F.col("transaction_id").cast("bigint")
    # every detector metric reads these scores again: materialise them once
    return cut_lineage(t.select(
        "transaction_id", "account_id",
        F.col("amount_zscore_in_category").alias("score"),
        F.col("amount_ratio_to_category_median").alias("ratio_score"),
        (F.col("amount_zscore_in_category") > 3.0).alias("zscore_flag"),
        (F.col("amount_ratio_to_category_median") > 3.0).alias("ratio_flag"),
        (eid % 31 == 0).alias("truth"),
        F.concat(F.lit("kind_"), (eid % 3).cast("string")).alias("kind")))


TXF_COLS = ["transaction_id", "account_id", "posted_date", "merchant", "category"] + \
    G.ANOMALY_FEATURES + ["has_history"]


@query("spend_only", with_ledgers(("raw", EV_SQL)) + ",\n" + LED + f"""
SELECT transaction_id, account_id, {r6('amount')} AS amount FROM led WHERE NOT is_inflow AND amount > 0""")
def q_spend_only(spark, sf):
    return flat(G.spend_only(normalised(events(spark, sf))).select("transaction_id", "account_id", "amount"))


@query("transaction_features", TXF_EV + "\nSELECT transaction_id, account_id, " + d10("posted_date")
       + " AS posted_date, merchant, category, "
       + ", ".join(f"{r6(n)} AS {n}" for n in G.ANOMALY_FEATURES) + ", has_history FROM txf")
def q_transaction_features(spark, sf):
    return flat(txf_events(spark, sf).select(*TXF_COLS))


@query("zscore_flags", TXF_EV + f"""
SELECT transaction_id, account_id, {r6('amount_zscore_in_category')} AS amount_zscore_in_category,
       amount_zscore_in_category > 3.0 AS zscore_flag FROM txf""")
def q_zscore_flags(spark, sf):
    return flat(G.zscore_flags(txf_events(spark, sf), 3.0)
                .select("transaction_id", "account_id", "amount_zscore_in_category", "zscore_flag"))


@query("transaction_vectors", TXF_EV + f"""
SELECT transaction_id, account_id, CAST({len(G.ANOMALY_FEATURES)} AS BIGINT) AS n_features,
       {', '.join(f"{r6(n)} AS {n}" for n in G.ANOMALY_FEATURES)} FROM txf""")
def q_transaction_vectors(spark, sf):
    """The map's values under their names."""
    v = G.transaction_vectors(txf_events(spark, sf))
    return flat(v.select("transaction_id", "account_id", F.size("features").cast("long").alias("n_features"),
                         *[F.col("features")[n].alias(n) for n in G.ANOMALY_FEATURES]))


_BROKEN = {n: f"CASE CAST(transaction_id AS BIGINT) % {11 + i} WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) "
              f"WHEN 2 THEN NULL ELSE {n} END" for i, n in enumerate(G.ANOMALY_FEATURES)}


@query("finite_check", TXF_EV + ",\nbroken AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _BROKEN.items()) + " FROM txf)\nSELECT "
       + ", ".join(f"count(*) FILTER (WHERE isnan({n}) OR isinf({n})) AS {n}__nonfinite, "
                   f"count(*) FILTER (WHERE {n} IS NULL) AS {n}__nulls" for n in G.ANOMALY_FEATURES) + " FROM broken")
def q_finite_check(spark, sf):
    """Every feature with some values broken by rule: NaN, infinity and null."""
    broken = txf_events(spark, sf).selectExpr(*[f"{x} AS {n}" for n, x in _BROKEN.items()])
    return flat(N.finite_check(broken, G.ANOMALY_FEATURES))


@query("explain_flags", TXF_EV + """,
fl AS (SELECT *, amount_zscore_in_category > 3.0 AS flagged FROM txf),
rs AS (SELECT transaction_id, account_id, flagged,
          CASE WHEN NOT flagged THEN [] ELSE
            coalesce(nullif(list_filter([
              CASE WHEN amount_zscore_in_category > 3.0 THEN printf('Amount is %.1f standard deviations above your usual for this category', amount_zscore_in_category) END,
              CASE WHEN amount_ratio_to_category_median > 3.0 THEN printf('About %.1fx your typical spend in this category', amount_ratio_to_category_median) END,
              CASE WHEN merchant_novelty = 1.0 THEN 'First time you''ve used this merchant' END,
              CASE WHEN merchant_txns_same_day >= 3 THEN CAST(CAST(merchant_txns_same_day AS BIGINT) AS VARCHAR) || ' charges at this merchant on the same day — a pattern that can indicate card testing' END,
              CASE WHEN category_rarity > 0.95 THEN 'This spending category is unusual for this account' END
            ], lambda x: x IS NOT NULL), []), ['Unusual combination of amount, timing and merchant history']) END AS reasons
       FROM fl)
SELECT transaction_id, account_id, flagged, array_to_string(reasons, '|') AS reasons, len(reasons) AS n_reasons FROM rs""")
def q_explain_flags(spark, sf):
    t = txf_events(spark, sf).withColumn("flagged", F.col("amount_zscore_in_category") > 3.0)
    e = X.explain_flags(t, "flagged")
    return flat(e.select("transaction_id", "account_id", "flagged", "reasons",
                         F.size("reasons").cast("long").alias("n_reasons")))


# --- J -----------------------------------------------------------------------

METRIC_COLS = ["flagged", "flag_rate", "precision", "recall", "f1", "false_positives", "missed"]


def _metrics_sql(flag: str, src: str = "scored") -> str:
    return f"""SELECT count(*) FILTER (WHERE {flag}) AS flagged,
       {r6(f'count(*) FILTER (WHERE {flag}) / count(*)')} AS flag_rate,
       {r6(f"CASE WHEN count(*) FILTER (WHERE {flag}) = 0 THEN 0 ELSE count(*) FILTER (WHERE {flag} AND truth) / count(*) FILTER (WHERE {flag}) END")} AS precision,
       {r6(f"CASE WHEN count(*) FILTER (WHERE truth) = 0 THEN 0 ELSE count(*) FILTER (WHERE {flag} AND truth) / count(*) FILTER (WHERE truth) END")} AS recall,
       {r6(f'''CASE WHEN count(*) FILTER (WHERE {flag} AND truth) = 0 THEN 0 ELSE
            2.0 * count(*) FILTER (WHERE {flag} AND truth) / (count(*) FILTER (WHERE {flag}) + count(*) FILTER (WHERE truth)) END''')} AS f1,
       count(*) FILTER (WHERE {flag} AND NOT truth) AS false_positives,
       count(*) FILTER (WHERE NOT {flag} AND truth) AS missed
FROM {src}"""


@query("metrics_at_threshold", SCORED_EV + "\nSELECT 'zscore' AS detector, * FROM (" + _metrics_sql("zscore_flag")
       + ") a UNION ALL SELECT 'ratio', * FROM (" + _metrics_sql("ratio_flag") + ") b")
def q_metrics_at_threshold(spark, sf):
    s = scored_events(spark, sf)
    z = J.metrics_at_threshold(s, "zscore_flag").select(F.lit("zscore").alias("detector"), *METRIC_COLS)
    r = J.metrics_at_threshold(s, "ratio_flag").select(F.lit("ratio").alias("detector"), *METRIC_COLS)
    return flat(z.unionByName(r))


@query("metrics_at_budget", SCORED_EV + f""",
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, transaction_id ASC) <= {BUDGET} AS bflag FROM scored)
SELECT CAST({BUDGET} AS BIGINT) AS budget, * FROM ({_metrics_sql('bflag', 'rk')}) m""")
def q_metrics_at_budget(spark, sf):
    return flat(J.metrics_at_budget(scored_events(spark, sf), BUDGET, "score")
                .select("budget", *METRIC_COLS))


def _ap_sql(score: str) -> str:
    return f"""(WITH ps AS (SELECT {score} AS s, count(*) AS n, count(*) FILTER (WHERE truth) AS pos
                  FROM scored GROUP BY {score}),
        c AS (SELECT *, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_n,
                        sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_pos FROM ps),
        tp AS (SELECT count(*) FILTER (WHERE truth) AS p FROM scored)
   SELECT coalesce(sum(CASE WHEN p > 0 THEN (pos / p) * (cum_pos / cum_n) END), 0.0) FROM c, tp)"""


@query("average_precision", SCORED_EV + f"""
SELECT {r6(_ap_sql('score'))} AS average_precision""")
def q_average_precision(spark, sf):
    return flat(J.average_precision(scored_events(spark, sf), "score"))


@query("recall_by_kind", SCORED_EV + f"""
SELECT kind, count(*) AS planted, {r6('avg(CAST(zscore_flag AS DOUBLE))')} AS zscore_flag_recall,
       {r6('avg(CAST(ratio_flag AS DOUBLE))')} AS ratio_flag_recall
FROM scored WHERE truth GROUP BY kind""")
def q_recall_by_kind(spark, sf):
    return flat(J.recall_by_kind(scored_events(spark, sf), ["zscore_flag", "ratio_flag"]))


@query("compare_detectors", SCORED_EV + f""",
d AS (SELECT 'zscore' AS detector, {_ap_sql('score')} AS average_precision, * FROM ({_metrics_sql('zscore_flag')}) a
      UNION ALL
      SELECT 'ratio', {_ap_sql('ratio_score')}, * FROM ({_metrics_sql('ratio_flag')}) b),
r AS (SELECT *, row_number() OVER (ORDER BY average_precision DESC, detector ASC) AS rk FROM d)
SELECT detector, {r6('average_precision')} AS average_precision, flagged, precision, recall, f1,
       (SELECT detector FROM r WHERE rk = 1) AS winner,
       {r6('(SELECT max(average_precision) FROM r) - (SELECT max(average_precision) FROM r WHERE rk = 2)')} AS ap_margin
FROM r""")
def q_compare_detectors(spark, sf):
    s = scored_events(spark, sf)
    rows = None
    for det, score, flag in (("zscore", "score", "zscore_flag"), ("ratio", "ratio_score", "ratio_flag")):
        m = J.metrics_at_threshold(s, flag).select(
            F.lit(det).alias("detector"), "flagged", "precision", "recall", "f1",
            J.average_precision(s, score).scalar().alias("average_precision"))
        rows = m if rows is None else rows.unionByName(m)
    return flat(J.compare_detectors(rows))
