"""I: clustering validation; J: anomaly evaluation.

Inputs are plain columns so any detector can be evaluated:
  labelled: (truth, cluster)                        for I
  scored:   (transaction_id, score, flag, truth[, kind])  for J
All metrics are aggregates (partial aggregation, no collect); ranks over the
whole set use the distributed `global_running` scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.scan import global_running


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# --- I -----------------------------------------------------------------------

def contingency(labelled: DataFrame, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("n"))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2.0


def adjusted_rand_index(labelled: DataFrame, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    """ARI from the contingency table (pure aggregates), rounded to 3."""
    cells = contingency(labelled, truth, cluster)
    rows = cells.groupBy(truth).agg(F.sum("n").alias("a"))
    cols = cells.groupBy(cluster).agg(F.sum("n").alias("b"))
    one = cells.agg(F.sum(_pairs(F.col("n"))).alias("index"), F.sum("n").alias("total"),
                    rows.agg(F.sum(_pairs(F.col("a")))).scalar().alias("sum_a"),
                    cols.agg(F.sum(_pairs(F.col("b")))).scalar().alias("sum_b"))
    expected = F.col("sum_a") * F.col("sum_b") / _pairs(F.col("total"))
    maximum = (F.col("sum_a") + F.col("sum_b")) / 2.0
    ari = F.when(maximum - expected == 0, F.lit(1.0)).otherwise(
        (F.col("index") - expected) / (maximum - expected))
    return one.select(F.round(ari, 3).alias("adjusted_rand_index"), F.col("total").alias("n_months"))


def purity(labelled: DataFrame, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    """Σ over true labels of the largest cell, over the total; rounded to 3."""
    cells = contingency(labelled, truth, cluster)
    best = cells.groupBy(truth).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.agg(F.round(F.sum("m") / F.sum("t"), 3).alias("purity"))


def crosstab(labelled: DataFrame, clusters: list[int], truth: str = "truth",
             cluster: str = "cluster") -> DataFrame:
    """Truth x cluster counts; pivot values given so no extra distinct job runs."""
    return (labelled.groupBy(truth).pivot(cluster, clusters).agg(F.count(F.lit(1)))
            .na.fill(0, [str(c) for c in clusters])
            .select(truth, *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters]))


# --- J -----------------------------------------------------------------------

def metrics_at_threshold(scored: DataFrame, flag: str = "flag", truth: str = "truth",
                         by: list[str] | None = None) -> DataFrame:
    """Flagged, flag rate, precision, recall, F1 (0 on zero division), FP, missed."""
    by = by or []
    f, t = F.col(flag), F.col(truth)
    g = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(f).alias("flagged"),
        F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("false_positives"),
        F.count_if(~f & t).alias("missed"))
    p = _safe_div(F.col("tp"), F.col("flagged"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("missed"))
    return g.select(*by, "flagged", (F.col("flagged") / F.col("rows")).alias("flag_rate"),
                    p.alias("precision"), r.alias("recall"),
                    _safe_div(2 * p * r, p + r).alias("f1"), "false_positives", "missed")


def flag_top_budget(scored: DataFrame, budget: int, score: str = "score",
                    tiebreak: str = "transaction_id") -> DataFrame:
    """Flag exactly `budget` rows: highest score first, ties by id.

    A running count over the distinct scores finds the score at which the budget runs out;
    only the rows with exactly that score are ranked by id. Rows without a score come last.
    """
    counts = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    run = global_running(counts, [F.desc("_s")], {"_upto": F.col("_n")}, rank_col="_r")
    cut = run.filter((F.col("_upto") >= budget) & (F.col("_upto") - F.col("_n") < budget)).first()
    s = F.col(score)
    if cut is None:  # fewer scored rows than the budget
        return scored.withColumn("flag", s.isNotNull())
    here = F.coalesce(s == F.lit(cut["_s"]), F.lit(False))
    ties = global_running(scored.filter(here), [F.asc(tiebreak)], rank_col="_tie")
    left = budget - (cut["_upto"] - cut["_n"])
    above = scored.filter(~here).withColumn("flag", F.coalesce(s > F.lit(cut["_s"]), F.lit(False)))
    return above.unionByName(ties.withColumn("flag", F.col("_tie") <= left).drop("_tie"))


def metrics_at_budget(scored: DataFrame, budget: int, score: str = "score",
                      truth: str = "truth") -> DataFrame:
    """J4 after flagging exactly `budget` highest scores."""
    flagged = flag_top_budget(scored.drop("flag") if "flag" in scored.columns else scored, budget, score)
    return metrics_at_threshold(flagged, "flag", truth).withColumn("budget", F.lit(budget))


def average_precision(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Σ (R_n - R_{n-1}) · P_n over distinct score thresholds (descending).

    Rows are first collapsed per distinct score (partial aggregation), then a
    distributed running sum over the distinct scores gives P and R.
    """
    per_score = scored.groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(truth)).alias("_pos"))
    run = global_running(per_score, [F.desc("_s")],
                         {"cum_n": F.col("_n"), "cum_pos": F.col("_pos")}, rank_col="_r")
    total_pos = scored.agg(F.count_if(F.col(truth))).scalar()
    return (run.withColumn("_P", total_pos)
            .agg(F.sum(F.when(F.col("_P") > 0,
                              (F.col("_pos") / F.col("_P")) * (F.col("cum_pos") / F.col("cum_n")))
                       ).alias("average_precision"))
            .select(F.coalesce("average_precision", F.lit(0.0)).alias("average_precision")))


def recall_by_kind(scored: DataFrame, flags: list[str], kind: str = "kind",
                   truth: str = "truth") -> DataFrame:
    """Per anomaly kind, planted count and recall of each detector flag."""
    return (scored.filter(F.col(truth)).groupBy(kind)
            .agg(F.count(F.lit(1)).alias("planted"),
                 *[F.avg(F.col(f).cast("double")).alias(f"{f}_recall") for f in flags]))


def compare_detectors(per_detector: DataFrame) -> DataFrame:
    """Metric rows per detector (detector, average_precision, ...) plus the
    winner by AP and its margin over the runner-up."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("average_precision"), F.asc("detector"))
    # per_detector has one row per detector (a handful), so a global window is bounded
    ranked = per_detector.withColumn("_r", F.row_number().over(w))
    winner = ranked.filter(F.col("_r") == 1).select("detector").scalar()
    margin = ranked.agg(F.max("average_precision")
                        - F.max(F.when(F.col("_r") == 2, F.col("average_precision")))).scalar()
    return ranked.drop("_r").select("*", winner.alias("winner"), margin.alias("ap_margin"))


# --- J1-J3 -------------------------------------------------------------------

def split_accounts(spend: DataFrame, seed: int = 42, train: float = 0.6,
                   val: float = 0.2) -> DataFrame:
    """Accounts -> train / val / test by their rank under md5(seed || account).

    Counts use int() truncation; the rest goes to test. The rank is over the
    distinct accounts only (a far smaller set than the rows), computed with the
    distributed global scan.
    """
    accts = spend.select("account_id").distinct().withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("account_id").cast("string"))))
    ranked = global_running(accts, [F.asc("_h"), F.asc("account_id")], rank_col="_r")
    total = ranked.agg(F.max("_r")).scalar()  # of the ranks written: the rows are read once
    n_train = F.floor(total * train)
    n_val = F.floor(total * val)
    return ranked.select(
        "account_id",
        F.when(F.col("_r") <= n_train, "train")
         .when(F.col("_r") <= n_train + n_val, "val").otherwise("test").alias("split"))
