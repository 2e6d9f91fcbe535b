"""Plain-language reasons for flagged transactions (rules over features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reason thresholds and sentences.
Z_LIMIT = 3.0
RATIO_LIMIT = 3.0
SAME_DAY_LIMIT = 3
RARITY_LIMIT = 0.95
Z_TEXT = "Amount is %.1f standard deviations above your usual for this category"
RATIO_TEXT = "About %.1fx your typical spend in this category"
NOVEL_TEXT = "First time you've used this merchant"
BURST_TEXT = " charges at this merchant on the same day — a pattern that can indicate card testing"
RARE_TEXT = "This spending category is unusual for this account"
DEFAULT_TEXT = "Unusual combination of amount, timing and merchant history"


def _one_decimal(x: Column) -> Column:
    """x rounded to one decimal the way Python's '%.1f' does it: half-to-even on
    the exact binary value (Java's %f rounds the shortest decimal form half up).

    x*10 is split into hi + lo exactly (Dekker's two-product), so a value that
    only looks like a tie in decimal is resolved by the sign of lo.
    """
    hi = x * 10.0
    c = x * 134217729.0  # 2^27 + 1: Dekker split of x
    x_hi = c - (c - x)
    x_lo = x - x_hi
    lo = (x_hi * 10.0 - hi) + x_lo * 10.0
    base = F.floor(hi)
    tie = (hi - base) == 0.5
    n = (F.when(tie & (lo > 0), base + 1.0)
         .when(tie & (lo < 0), base)
         .otherwise(F.rint(hi)))
    return n / 10.0


def reasons_for(z: Column, ratio: Column, novelty: Column, same_day: Column, rarity: Column) -> Column:
    found = F.array_compact(F.array(
        F.when(z > Z_LIMIT, F.format_string(Z_TEXT, _one_decimal(z))),
        F.when(ratio > RATIO_LIMIT, F.format_string(RATIO_TEXT, _one_decimal(ratio))),
        F.when(novelty == 1.0, F.lit(NOVEL_TEXT)),
        F.when(same_day >= SAME_DAY_LIMIT,
               F.concat(same_day.cast("bigint").cast("string"), F.lit(BURST_TEXT))),
        F.when(rarity > RARITY_LIMIT, F.lit(RARE_TEXT)),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit(DEFAULT_TEXT))).otherwise(found)


def explain_flags(scored: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Ordered reasons for flagged rows; an empty list for normal rows."""
    r = reasons_for(F.col("amount_zscore_in_category"), F.col("amount_ratio_to_category_median"),
                    F.col("merchant_novelty"), F.col("merchant_txns_same_day"),
                    F.col("category_rarity"))
    return scored.withColumn("reasons", F.when(F.col(flag), r)
                             .otherwise(F.array().cast("array<string>")))
