"""G: twelve strictly causal per-transaction features (plus has_history).

"Past" means rows strictly before the current one in the account's order
(posted_date, transaction_id); their statistics come from `expanding`, which
reads an account in one task only while it fits a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.operators.expanding import BLOCK_ROWS, expanding

# Model feature order (positional contract of the forest tables).
ANOMALY_FEATURES = [
    "amount",
    "amount_log",
    "amount_zscore_in_category",
    "amount_ratio_to_category_median",
    "merchant_novelty",
    "merchant_frequency",
    "is_weekend",
    "day_of_month",
    "days_since_previous",
    "category_rarity",
    "merchant_txns_same_day",
    "account_txns_same_day",
]
MIN_HISTORY = 5
FIRST_GAP_DAYS = 30.0
SATURDAY = 5  # weekday(): Monday = 0; the per-transaction weekend is Saturday..Sunday


def spend_only(ledger: DataFrame) -> DataFrame:
    """Outflows with a positive amount (drops income and refunds)."""
    return ledger.filter(~F.col("is_inflow") & (F.col("amount") > 0))


def _scaled(amt: Column, center: Column, spread: Column) -> Column:
    # pandas clip(lower=1) keeps NaN while greatest(NULL, 1) = 1: guard the null first
    return F.when(spread.isNotNull(), (amt - center) / F.greatest(spread, F.lit(1.0)))


def _ratio(amt: Column, median: Column) -> Column:
    return F.when(median.isNotNull(), amt / F.greatest(median, F.lit(1.0)))


def transaction_features(ledger: DataFrame, min_history: int = MIN_HISTORY,
                         carry: list[str] | tuple = (), block_rows: int = BLOCK_ROWS,
                         labels: list[str] | tuple = ("month", "merchant", "category")) -> DataFrame:
    """G1-G15 for every scorable transaction of a normalised ledger.

    `carry` names extra input columns passed through unchanged (labels), `labels` those of the ledger's texts and month that
    are wanted beside the features.
    """
    kept = ["transaction_id", "account_id", "posted_date", *labels, "_amount", *carry]
    rows = spend_only(ledger).withColumn("_amount", F.col("amount").cast("double"))
    stats = expanding(rows.select(*dict.fromkeys([*kept, "merchant", "category", "amount"])), block_rows, kept)
    amt = F.col("_amount")
    z = F.coalesce(_scaled(amt, F.col("_c_mean"), F.col("_c_std")),
                   _scaled(amt, F.col("_a_mean"), F.col("_a_std")), F.lit(0.0))
    ratio = F.coalesce(_ratio(amt, F.col("_c_med")), _ratio(amt, F.col("_a_med")), F.lit(1.0))
    return stats.select(
        "transaction_id", "account_id", "posted_date", *labels,
        amt.alias("amount"),
        F.log1p(F.greatest(amt, F.lit(0.0))).alias("amount_log"),
        z.alias("amount_zscore_in_category"),
        ratio.alias("amount_ratio_to_category_median"),
        (F.col("_m_cnt") == 0).cast("double").alias("merchant_novelty"),
        F.col("_m_cnt").cast("double").alias("merchant_frequency"),
        (F.weekday("posted_date") >= SATURDAY).cast("double").alias("is_weekend"),
        F.dayofmonth("posted_date").cast("double").alias("day_of_month"),
        F.coalesce(F.datediff("posted_date", "_prev_date").cast("double"),
                   F.lit(FIRST_GAP_DAYS)).alias("days_since_previous"),
        (F.lit(1.0) - F.col("_c_cnt") / F.greatest(F.col("_a_cnt"), F.lit(1))).alias("category_rarity"),
        F.col("_m_day").cast("double").alias("merchant_txns_same_day"),
        F.col("_a_day").cast("double").alias("account_txns_same_day"),
        (F.col("_c_cnt") >= min_history).cast("int").alias("has_history"),
        *carry,
    )


def transaction_vectors(features: DataFrame) -> DataFrame:
    """transaction_id -> map of the 12 named features."""
    kv = []
    for n in ANOMALY_FEATURES:
        kv += [F.lit(n), F.col(n)]
    return features.select("transaction_id", "account_id", F.create_map(*kv).alias("features"))


def zscore_flags(features: DataFrame, threshold: float = 3.0) -> DataFrame:
    """H1: z-score baseline; strict `>`, so a higher threshold flags a subset."""
    return features.withColumn("zscore_flag", F.col("amount_zscore_in_category") > threshold)
