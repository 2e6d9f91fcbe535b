"""E: recurring-charge detection. Two rules that differ on purpose; both kept.

E1 `flag_recurring` (feature rule): aggregate per (account, merchant,
amount_key) with partial aggregation, then a left join of the qualifying keys
back onto every row. The key table grows with the data, so the join is left
to AQE (sort-merge, skew-split of a hot key on the streamed side) instead of a
forced broadcast.

E2 `find_subscriptions` (report rule): monthly buckets, cadence and dominance
checks, one row per merchant. The merchant total is a window over the already
aggregated monthly rows, so the plan shuffles the ledger once and reuses the
(account, merchant) partitioning for the bucket aggregate and the pick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.ledger import month_of

KEY = ["account_id", "merchant", "amount_key"]

# Fixed values of the rules.
MIN_MONTHS = 3
REL_TOLERANCE = 0.05
MEAN_FLOOR = 0.01
AS_OF_MONTHS = 12
CADENCE = 1.5
DOMINANCE = 0.8


def recurring_keys(ledger: DataFrame) -> DataFrame:
    """Qualifying (account, merchant, amount_key) of E1 with their stats."""
    out = (ledger.filter(~F.col("is_inflow"))
                 .select("account_id", "merchant", "month",
                         F.bround("amount", 0).alias("amount_key"),
                         F.col("amount").cast("double").alias("amt")))
    stats = out.groupBy(*KEY).agg(
        F.countDistinct("month").alias("months"),
        F.avg("amt").alias("mean_amount"),
        F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("std_amount"))
    return stats.filter(
        (F.col("months") >= MIN_MONTHS)
        & (F.col("std_amount") <= REL_TOLERANCE * F.greatest(F.abs("mean_amount"), F.lit(MEAN_FLOOR))))


def flag_recurring(ledger: DataFrame) -> DataFrame:
    """Add `is_recurring` to every row of a normalised ledger (inflows false)."""
    keys = recurring_keys(ledger).select(*KEY, F.lit(True).alias("_rec"))
    return (ledger.withColumn("amount_key", F.bround("amount", 0))
            .join(keys, KEY, "left")
            .withColumn("is_recurring", F.coalesce(F.col("_rec"), F.lit(False)) & ~F.col("is_inflow"))
            .drop("_rec", "amount_key"))


def find_subscriptions(raw: DataFrame) -> DataFrame:
    """E2 per account: merchant, category, typical_amount, months_seen,
    first_seen, last_seen (amount_key = half-away round of the decimal)."""
    pos = raw.filter(F.col("amount") > 0)
    monthly = (pos.groupBy("account_id", "merchant", F.round("amount", 0).alias("amount_key"),
                           month_of("posted_date").alias("month"))
               .agg(F.min("category").alias("category"),
                    F.avg(F.col("amount").cast("double")).alias("amount"),
                    F.count(F.lit(1)).alias("charges_in_month"),
                    F.min("posted_date").alias("first_seen"),
                    F.max("posted_date").alias("last_seen")))
    per_merchant = Window.partitionBy("account_id", "merchant")
    monthly = monthly.withColumn("merchant_charges", F.sum("charges_in_month").over(per_merchant))
    buckets = (monthly.groupBy("account_id", "merchant", "amount_key")
               .agg(F.min("category").alias("category"),
                    F.avg("amount").alias("typical_amount"),
                    F.count(F.lit(1)).alias("months_seen"),
                    F.sum("charges_in_month").alias("total_charges"),
                    F.min("first_seen").alias("first_seen"),
                    F.max("last_seen").alias("last_seen"),
                    F.max("merchant_charges").alias("merchant_charges"))
               .filter((F.col("months_seen") >= MIN_MONTHS)
                       & (F.col("total_charges") <= F.col("months_seen") * CADENCE)
                       & (F.col("total_charges") >= F.col("merchant_charges") * DOMINANCE)))
    pick = Window.partitionBy("account_id", "merchant").orderBy(F.desc("typical_amount"),
                                                                F.asc("amount_key"))
    return (buckets.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") == 1)
            .select("account_id", "merchant", "category", "typical_amount", "months_seen",
                    "first_seen", "last_seen"))


def recurring_rule_divergence(flagged: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(account, merchant) with an E1-recurring row but no E2 subscription."""
    e1 = (flagged.filter("is_recurring").groupBy("account_id", "merchant")
          .agg(F.count(F.lit(1)).alias("recurring_rows"),
               F.sum(F.col("amount").cast("double")).alias("recurring_amount")))
    return e1.join(subscriptions.select("account_id", "merchant"), ["account_id", "merchant"], "left_anti")


def flag_recurring_as_of(ledger: DataFrame, months: int = AS_OF_MONTHS) -> DataFrame:
    """E1 as seen by a month-M request: the rule evaluated on months M-11..M only.

    Per (key, month) partial sums (n, Σx, Σx²) slide over a 12-month RANGE
    window on a month ordinal — no range self-join, no row pairs — and the
    month's rows take that month's verdict. With at most 12 months of history
    this equals `flag_recurring` on the last month.
    """
    out = (ledger.filter(~F.col("is_inflow"))
           .select(*KEY[:2], "month", F.bround("amount", 0).alias("amount_key"),
                   F.col("amount").cast("double").alias("amt")))
    monthly = out.groupBy(*KEY, "month").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("s"),
                                             F.sum(F.col("amt") * F.col("amt")).alias("q"))
    ordinal = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy(*KEY).orderBy(ordinal).rangeBetween(-(months - 1), Window.currentRow)
    win = monthly.select(*KEY, "month", F.count(F.lit(1)).over(w).alias("months"),
                         F.sum("n").over(w).alias("N"), F.sum("s").over(w).alias("S"),
                         F.sum("q").over(w).alias("Q"))
    mean = F.col("S") / F.col("N")
    var = F.when(F.col("N") > 1, (F.col("Q") - F.col("S") * F.col("S") / F.col("N")) / (F.col("N") - 1)) \
        .otherwise(F.lit(0.0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    verdict = win.select(*KEY, "month", ((F.col("months") >= MIN_MONTHS)
                                         & (std <= REL_TOLERANCE * F.greatest(F.abs(mean), F.lit(MEAN_FLOOR))))
                         .alias("_rec"))
    return (ledger.withColumn("amount_key", F.bround("amount", 0))
            .join(verdict, [*KEY, "month"], "left")
            .withColumn("is_recurring", F.coalesce(F.col("_rec"), F.lit(False)) & ~F.col("is_inflow"))
            .drop("_rec", "amount_key"))
