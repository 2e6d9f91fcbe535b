"""Registered queries for H12-H15, H17, H18 and J1-J3, plus the end-to-end flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import evaluate as J
from kontor.operators import iforest as IF
from kontor.operators.causal import ANOMALY_FEATURES, spend_only
from kontor.operators import inject as INJ
from kontor.operators.inject import inject_anomalies, prepare_eval_set
from kontor.plans import flows as P
from kontor.plans.common import EV_SQL, catalogue, events, normalised, with_ledgers
from kontor.plans.q_anomaly import TXF_EV, txf_events
from kontor.plans.registry import d10, flat, query, r6
from kontor.plans.sql_blocks import LED, TXF

GRID = IF.CONTAMINATION_GRID


@query("iforest_fit")
def q_iforest_fit(spark, sf):
    nodes, psi = IF.iforest_fit(txf_events(spark, sf), ANOMALY_FEATURES)
    return (nodes.groupBy("tree")
            .agg(F.count(F.lit(1)).alias("nodes"), F.count_if("leaf").alias("leaves"),
                 F.max("depth").alias("max_depth"), F.max("size").alias("root_size"))
            .withColumn("psi", F.lit(psi)))


@query("iforest_score")
def q_iforest_score(spark, sf):
    t = txf_events(spark, sf)
    nodes, psi = IF.iforest_fit(t, ANOMALY_FEATURES)
    return IF.iforest_score(t, nodes, psi, ANOMALY_FEATURES).select(
        "transaction_id", "account_id", F.round("anomaly_score", 4).alias("anomaly_score"))


@query("score_transactions")
def q_score_transactions(spark, sf):
    led = P.scorable(normalised(events(spark, sf)))
    model, scored = P.fit_and_score(led, P.split_of(led))
    out = P.anomaly_scan(led, model, f"iforest-c{model.contamination}", scored)
    return out.withColumn("reasons", F.array_join("reasons", "|"))


# z-score detector stands in for the forest where an SQL twin is wanted:
# "train" = accounts with account_id % 5 < 3, validation = the rest.
_TRAIN = "account_id % 5 < 3"


@query("contamination_threshold", TXF_EV + f""",
thr AS (SELECT quantile_cont(amount_zscore_in_category, 0.98) AS t FROM txf WHERE {_TRAIN})
SELECT {r6('t')} AS threshold,
       (SELECT count(*) FROM txf WHERE NOT ({_TRAIN}) AND amount_zscore_in_category > t) AS flagged
FROM thr""")
def q_contamination_threshold(spark, sf):
    t = txf_events(spark, sf)
    thr = IF.contamination_threshold(t.filter(_TRAIN), 0.02, "amount_zscore_in_category")
    flagged = t.filter(f"NOT ({_TRAIN})").filter(F.col("amount_zscore_in_category") > thr)
    return flat(flagged.agg(F.count(F.lit(1)).alias("flagged")).select(
        F.lit(thr).alias("threshold"), "flagged"))


def _tune_sql() -> str:
    arms = []
    for i, c in enumerate(GRID):
        q = 1.0 - c
        arms.append(f"""SELECT {c} AS contamination, {i} AS position,
  (SELECT quantile_cont(amount_zscore_in_category, {q!r}) FROM txf WHERE {_TRAIN}) AS threshold""")
    return TXF_EV + f""",
g AS ({' UNION ALL '.join(arms)}),
val AS (SELECT amount_zscore_in_category AS s, CAST(transaction_id AS BIGINT) % 31 = 0 AS truth
        FROM txf WHERE NOT ({_TRAIN})),
m AS (SELECT contamination, position, threshold,
             (SELECT count(*) FROM val) AS n_rows,
             (SELECT count(*) FROM val WHERE truth) AS pos,
             (SELECT count(*) FROM val WHERE s > threshold) AS fl,
             (SELECT count(*) FROM val WHERE s > threshold AND truth) AS tp FROM g),
p AS (SELECT *, CASE WHEN fl > 0 THEN tp / fl ELSE 0.0 END AS pr,
                CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END AS rc FROM m),
f AS (SELECT *, round(pr, 3) AS precision, round(rc, 3) AS recall,
                round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 3) AS f1,
                round(fl / n_rows, 4) AS flag_rate FROM p)
SELECT {r6('contamination')} AS contamination, {r6('threshold')} AS threshold, {r6('precision')} AS precision,
       {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('flag_rate')} AS flag_rate,
       position = (SELECT arg_min(position, (-f1, position)) FROM f) AS chosen
FROM f"""


@query("tune_contamination", _tune_sql())
def q_tune_contamination(spark, sf):
    t = txf_events(spark, sf)
    val = t.filter(f"NOT ({_TRAIN})").select(
        F.col("amount_zscore_in_category").alias("anomaly_score"),
        (F.col("transaction_id").cast("bigint") % 31 == 0).alias("truth"))
    return flat(IF.tune_contamination(t.filter(_TRAIN).select(
        F.col("amount_zscore_in_category").alias("anomaly_score")), val))


@query("model_version", TXF_EV + """
SELECT transaction_id, 'kmeans-k6+iforest-c0.02' AS model_version FROM txf""")
def q_model_version(spark, sf):
    return txf_events(spark, sf).select("transaction_id", F.lit(IF.model_version(6, 0.02)).alias("model_version"))


@query("split_accounts", with_ledgers(("raw", EV_SQL)) + ",\n" + LED + """,
a AS (SELECT DISTINCT account_id FROM led WHERE NOT is_inflow AND amount > 0),
r AS (SELECT account_id, row_number() OVER (ORDER BY md5('42|' || CAST(account_id AS VARCHAR)), account_id) AS rk,
             count(*) OVER () AS n FROM a)
SELECT account_id, CASE WHEN rk <= floor(n * 0.6) THEN 'train'
                        WHEN rk <= floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split
FROM r""")
def q_split_accounts(spark, sf):
    return J.split_accounts(spend_only(normalised(events(spark, sf))), seed=42)


def _draw_sql(kind: str, pick: str, tag: str, seed: int = 7) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', {kind}, CAST({pick} AS VARCHAR), '{tag}')), 1, 8))"
            f"::BIGINT / 4294967296.0)")


_KINDS = ", ".join(f"'{k}'" for k in INJ.ANOMALY_KINDS)
_FRAUD = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in INJ.FRAUD_MERCHANTS) + "]"
_NOVEL = "[" + ", ".join(f"'{c}'" for c in INJ.NOVEL_CANDIDATES) + "]"

def _inject_ctes(spend_where: str = "true") -> str:
    return f"""
spend AS (SELECT * FROM led WHERE NOT is_inflow AND amount > 0 AND {spend_where}),
counts AS (SELECT account_id, count(*) AS n FROM spend GROUP BY account_id),
elig AS (SELECT account_id, row_number() OVER (ORDER BY account_id) AS rk FROM counts WHERE n >= {INJ.MIN_ROWS}),
picks0 AS (SELECT [{_KINDS}][CAST(floor(id / 8) AS INTEGER) + 1] AS kind, CAST(id % 8 AS INTEGER) AS i
           FROM range(0, 24) t(id)),
picks AS (SELECT p.*, e.account_id FROM picks0 p JOIN elig e
            ON e.rk = CAST(floor({_draw_sql('p.kind', 'p.i', 'account')} * (SELECT count(*) FROM elig)) AS BIGINT) + 1),
rows_ AS (SELECT * FROM spend WHERE account_id IN (SELECT account_id FROM picks)),
per_day AS (SELECT account_id, posted_date, count(*) AS c FROM rows_ GROUP BY ALL),
anchor AS (SELECT pd.account_id, min(posted_date) AS anchor
           FROM (SELECT *, sum(c) OVER (PARTITION BY account_id ORDER BY posted_date ROWS UNBOUNDED PRECEDING) AS cum
                 FROM per_day) pd JOIN counts c ON pd.account_id = c.account_id
           WHERE cum > floor(c.n * {INJ.ANCHOR_AT}) GROUP BY pd.account_id),
stats AS (SELECT account_id, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS typical, list(DISTINCT category) AS used
          FROM rows_ GROUP BY account_id),
topcat AS (SELECT account_id, arg_min(category, (-c, category)) AS modal_category
           FROM (SELECT account_id, category, count(*) AS c FROM rows_ GROUP BY ALL) x GROUP BY account_id),
merch AS (SELECT account_id, arg_min(merchant, (-c, merchant)) AS modal_merchant
          FROM (SELECT r.account_id, r.merchant, count(*) AS c FROM rows_ r JOIN topcat t
                  ON r.account_id = t.account_id AND r.category = t.modal_category GROUP BY ALL) x
          GROUP BY account_id),
p AS (SELECT picks.*, anchor, typical, used, modal_category, modal_merchant,
             coalesce(nullif(list_filter({_NOVEL}, lambda c: NOT list_contains(used, c)), []), ['shopping']) AS unused,
             {_FRAUD}[CAST(floor({_draw_sql('picks.kind', 'picks.i', 'merchant')} * {len(INJ.FRAUD_MERCHANTS)}) AS INTEGER) + 1] AS fraud
      FROM picks JOIN anchor USING (account_id) JOIN stats USING (account_id)
                 JOIN topcat USING (account_id) JOIN merch USING (account_id)),
inj AS (
  SELECT 'inj-amount_spike-' || CAST(i AS VARCHAR) AS transaction_id, account_id,
         CAST(anchor + INTERVAL 2 DAY AS DATE) AS posted_date,
         round(typical * (8.0 + 7.0 * {_draw_sql('kind', 'i', 'amount')}), 2) AS amount,
         modal_merchant AS merchant, modal_category AS category, kind
  FROM p WHERE kind = 'amount_spike'
  UNION ALL
  SELECT 'inj-novel_category_splurge-' || CAST(i AS VARCHAR), account_id, CAST(anchor + INTERVAL 3 DAY AS DATE),
         round(typical * (12.0 + 13.0 * {_draw_sql('kind', 'i', 'amount')}), 2), fraud,
         unused[CAST(floor({_draw_sql('kind', 'i', 'category')} * len(unused)) AS INTEGER) + 1], kind
  FROM p WHERE kind = 'novel_category_splurge'
  UNION ALL
  SELECT 'inj-card_testing_burst-' || CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR), account_id,
         CAST(anchor + INTERVAL 4 DAY AS DATE),
         round(1.0 + 5.0 * {_draw_sql('kind', "CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR)", 'amount')}, 2),
         fraud, 'shopping', kind
  FROM p, range(0, {INJ.BURST_SIZE}) t(j) WHERE kind = 'card_testing_burst')"""


INJECT_SQL = with_ledgers(("raw", EV_SQL)) + ",\n" + LED + ",\n" + _inject_ctes() + f"""
SELECT transaction_id, account_id, {d10('posted_date')} AS posted_date, {r6('CAST(amount AS DECIMAL(12,2))')} AS amount,
       merchant, category, false AS is_injected_anomaly, CAST(NULL AS VARCHAR) AS anomaly_kind FROM spend
UNION ALL
SELECT transaction_id, account_id, {d10('posted_date')}, {r6('CAST(amount AS DECIMAL(12,2))')},
       merchant, category, true, kind FROM inj"""


@query("inject_anomalies", INJECT_SQL)
def q_inject_anomalies(spark, sf):
    inj = inject_anomalies(spend_only(normalised(events(spark, sf))), 8, 7)
    return flat(inj.select("transaction_id", "account_id", "posted_date", "amount", "merchant", "category",
                           "is_injected_anomaly", "anomaly_kind"))


SPLITS_CTE = """
sa AS (SELECT DISTINCT account_id FROM led WHERE NOT is_inflow AND amount > 0),
sr AS (SELECT account_id, row_number() OVER (ORDER BY md5('42|' || CAST(account_id AS VARCHAR)), account_id) AS rk,
              count(*) OVER () AS n FROM sa),
splits AS (SELECT account_id, CASE WHEN rk <= floor(n * 0.6) THEN 'train'
                                   WHEN rk <= floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split
           FROM sr)"""

_TXF_ON_COMB = (TXF.replace("spend AS (SELECT *, CAST(amount AS DOUBLE) AS amt FROM led WHERE",
                            "spend2 AS (SELECT *, CAST(amount AS DOUBLE) AS amt FROM comb WHERE")
                .replace("FROM spend\n", "FROM spend2\n"))

PREPARE_SQL = (with_ledgers(("raw", EV_SQL)) + ",\n" + LED + ",\n" + SPLITS_CTE + ",\n"
               + _inject_ctes("account_id IN (SELECT account_id FROM splits WHERE split = 'val')") + """,
comb AS (SELECT transaction_id, account_id, posted_date, month, amount, merchant, category, false AS is_inflow,
                false AS is_injected_anomaly, CAST(NULL AS VARCHAR) AS anomaly_kind FROM spend
         UNION ALL
         SELECT transaction_id, account_id, posted_date, CAST(date_trunc('month', posted_date) AS DATE),
                CAST(amount AS DECIMAL(12,2)), merchant, category, false, true, kind FROM inj),""" + _TXF_ON_COMB + """
SELECT txf.transaction_id, txf.account_id, comb.is_injected_anomaly, comb.anomaly_kind, """
               + ", ".join(f"{r6('txf.' + c)} AS {c}" for c in ANOMALY_FEATURES)
               + " FROM txf JOIN comb ON txf.transaction_id = comb.transaction_id")


@query("prepare_eval_set", PREPARE_SQL)
def q_prepare_eval_set(spark, sf):
    led = normalised(events(spark, sf))
    splits = J.split_accounts(spend_only(led), seed=42)
    ev = prepare_eval_set(led, splits, "val", inject=True, seed=7)
    return flat(ev.select("transaction_id", "account_id", "is_injected_anomaly", "anomaly_kind",
                          *ANOMALY_FEATURES))


@query("evaluate_detectors")
def q_evaluate_detectors(spark, sf):
    return P.anomaly_evaluation(normalised(events(spark, sf)))


@query("evaluate_recall_by_kind")
def q_evaluate_recall_by_kind(spark, sf):
    _, scored = P.anomaly_evaluation(normalised(events(spark, sf)), with_scored=True)
    return P.recall_by_kind_eval(scored)


@query("archetypes")
def q_archetypes(spark, sf):
    out = P.archetypes(catalogue(spark, sf))
    return out.select("account_id", "month", "cluster", "archetype", "distance_to_centroid",
                      F.array_join(F.transform("evidence", lambda e: e["feature"]), "|").alias("evidence"),
                      "model_version")
