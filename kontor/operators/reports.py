"""D: aggregations and reporting views, for every account at once.

All reports aggregate with partial (map-side) aggregation first, so a hot
account or category is combined before the shuffle. Presentation order is
expressed as a rank column, not a global sort: a global ORDER BY over a 100 TB
result is a range-partitioning shuffle nobody reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.ledger import month_of
from kontor.session import cut_lineage


def _dec_round_half_up(c: Column, places: int) -> Column:
    """Java BigDecimal.setScale(places, HALF_UP) for exact decimals."""
    return F.round(c, places)


def category_summary(raw: DataFrame) -> DataFrame:
    """Per account-month-category: Σ amount and row count on RAW categories.

    Inflow rows stay in (negative totals). `rank` = order by total desc.
    """
    agg = (raw.withColumn("month", month_of("posted_date"))
              .groupBy("account_id", "month", "category")
              .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("txn_count")))
    w = Window.partitionBy("account_id", "month").orderBy(F.desc("total"), F.asc("category"))
    return agg.withColumn("rank", F.row_number().over(w))


def account_month_activity(raw: DataFrame) -> DataFrame:
    """Count per (account, 'yyyy-MM')."""
    return (raw.groupBy("account_id", F.date_format("posted_date", "yyyy-MM").alias("month"))
               .agg(F.count(F.lit(1)).alias("transaction_count")))


def account_activity(accounts: DataFrame, raw: DataFrame) -> DataFrame:
    """D3: per account: total rows and active months newest first; 0 / [] when none.

    The month list is bounded by the ledger's time span, not by its row count
    (collect_set keeps distinct months only, merged map-side).
    """
    act = (raw.groupBy("account_id")
              .agg(F.count(F.lit(1)).alias("transaction_count"),
                   F.reverse(F.sort_array(F.collect_set(
                       F.date_format("posted_date", "yyyy-MM")))).alias("months")))
    return (accounts.select("account_id").join(act, "account_id", "left")
            .select("account_id",
                    F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
                    F.coalesce("months", F.array().cast("array<string>")).alias("months")))


def positive_category_totals(raw: DataFrame | None, totals: DataFrame | None = None) -> DataFrame:
    """Category totals > 0 per account-month (outflow view of D1).

    `totals` (account_id, month, category, total) stands in for the ledger where D1 is at hand already, as
    in every report below.
    """
    if totals is None:
        totals = (raw.withColumn("month", month_of("posted_date")).groupBy("account_id", "month", "category")
                  .agg(F.sum("amount").alias("total")))
    return totals.select("account_id", "month", "category", "total").filter(F.col("total") > 0)


def month_outflow(raw: DataFrame | None, totals: DataFrame | None = None) -> DataFrame:
    """Σ of positive category totals per account-month."""
    return (positive_category_totals(raw, totals).groupBy("account_id", "month")
            .agg(F.sum("total").alias("total_spend")))


def spend_trend(raw: DataFrame, end_month: Column | None = None, count: int = 6) -> DataFrame:
    """The `count` months ending at `end_month` for every account, oldest first.

    Missing months are 0. `end_month` defaults to the ledger's latest month,
    planned as a scalar subquery (no join, no driver round trip). The month
    spine is a per-account `sequence`, so the grid is built without a cross
    join. The ledger is read once, into its category totals; accounts, the latest month
    and the outflow all come from that far smaller table.
    """
    sums = cut_lineage(raw.withColumn("month", month_of("posted_date")).groupBy("account_id", "month", "category")
                       .agg(F.sum("amount").alias("total")))
    if end_month is None:
        end_month = sums.agg(F.max("month")).scalar()
    start = F.add_months(end_month, 1 - count)
    grid = (sums.select("account_id").distinct()
            .select("account_id", F.posexplode(
                F.sequence(start, end_month, F.expr("INTERVAL 1 MONTH"))).alias("pos", "month"))
            .select("account_id", "month", (F.lit(count - 1) - F.col("pos")).alias("months_back")))
    totals = month_outflow(None, sums.filter((F.col("month") >= start) & (F.col("month") <= end_month)))
    return (grid.join(totals, ["account_id", "month"], "left")
            .select("account_id", "month", "months_back",
                    F.coalesce(F.col("total_spend"), F.lit(0).cast("decimal(38,2)")).alias("total")))


def trend_stats(trend: DataFrame) -> DataFrame:
    """Per account over months with total > 0: peak (first max in month
    order), average, count; per month the bar height total/peak·100 with a 2 %
    floor when total > 0."""
    has = F.col("total") > 0
    t = trend.withColumn("total_d", F.col("total").cast("double"))
    stats = (t.groupBy("account_id").agg(
        F.max(F.when(has, F.col("total_d"))).alias("peak_total"),
        F.min_by(F.when(has, F.col("month")),
                 F.when(has, F.struct(-F.col("total_d"), F.col("month")))).alias("peak_month"),
        F.avg(F.when(has, F.col("total_d"))).alias("average"),
        F.count(F.when(has, 1)).alias("months_with_data")))
    out = t.join(stats, "account_id")
    height = F.when(F.col("peak_total") > 0, F.col("total_d") / F.col("peak_total") * 100).otherwise(0.0)
    height = F.when(has, F.greatest(height, F.lit(2.0))).otherwise(height)
    return out.select("account_id", "month", "total_d", "peak_total", "peak_month",
                      "average", "months_with_data", height.alias("bar_height")) \
              .withColumnRenamed("total_d", "total")


def category_shares(raw: DataFrame) -> DataFrame:
    """Positive category totals with share of month and of the largest, rank."""
    pos = positive_category_totals(raw)
    p = Window.partitionBy("account_id", "month")
    ranked = Window.partitionBy("account_id", "month").orderBy(F.desc("total"), F.asc("category"))
    return pos.select(
        "account_id", "month", "category", "total",
        (F.col("total").cast("double") / F.sum(F.col("total").cast("double")).over(p)).alias("share_of_month"),
        (F.col("total").cast("double") / F.max(F.col("total").cast("double")).over(p)).alias("share_of_largest"),
        F.row_number().over(ranked).alias("rank"))


def top_categories(raw: DataFrame | None, n: int = 5, totals: DataFrame | None = None) -> DataFrame:
    """Top n positive totals per account-month; share rounded 4 places
    HALF_UP on exact decimals, amount 2 places."""
    pos = positive_category_totals(raw, totals)
    p = Window.partitionBy("account_id", "month")
    ranked = Window.partitionBy("account_id", "month").orderBy(F.desc("total"), F.asc("category"))
    with_tot = pos.select("*", F.sum("total").over(p).alias("total_spend"),
                          F.row_number().over(ranked).alias("rank"))
    return (with_tot.filter(F.col("rank") <= n)
            .select("account_id", "month", "rank", "category",
                    _dec_round_half_up(F.col("total"), 2).alias("amount"),
                    F.when(F.col("total_spend") > 0,
                           _dec_round_half_up(F.col("total") / F.col("total_spend"), 4))
                     .otherwise(F.lit(0)).cast("double").alias("share")))


def category_deltas(raw: DataFrame | None, min_pct: float = 20.0, totals: DataFrame | None = None) -> DataFrame:
    """Calendar month-over-month change per category (both totals > 0).

    change = round_half_up((cur - prev) / prev, 4) * 100, kept when
    |change| >= min_pct, reported as round(change*10)/10 (Java Math.round).
    The previous row of the category is last month's only if no month lies between.
    """
    w = Window.partitionBy("account_id", "category").orderBy("month")
    j = (positive_category_totals(raw, totals)
         .withColumn("prev_total", F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("total").over(w)))
         .filter(F.col("prev_total").isNotNull()))
    change = F.round((F.col("total") - F.col("prev_total")) / F.col("prev_total"), 4).cast("double") * 100
    return (j.withColumn("change", change)
            .filter(F.abs("change") >= min_pct)
            .select("account_id", "month", "category",
                    F.round("total", 2).alias("this_month"),
                    F.round("prev_total", 2).alias("last_month"),
                    (F.floor(F.col("change") * 10 + 0.5) / 10.0).alias("percent_change")))


def recurring_spend(raw: DataFrame | None, features: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """round(month_outflow * recurring_share, 2) half up on exact decimals (the share
    through its text form); 0 with no feature row. Where refunds leave little discretionary spend, the share can be of
    any size: from 10 on it keeps ten decimals."""
    out = month_outflow(raw, totals)
    f = features.select("account_id", "month", "recurring_share")
    spent, share = F.col("total_spend").cast("decimal(18,2)"), F.col("recurring_share").cast("string")
    part = lambda places: F.round(spent * share.cast(places), 2).cast("decimal(20,2)")
    spend = F.when(F.abs("recurring_share") < 10, part("decimal(19,18)")).otherwise(part("decimal(28,10)"))
    return (out.join(f, ["account_id", "month"], "left")
            .select("account_id", "month", "total_spend",
                    F.coalesce(spend, F.lit(0).cast("decimal(20,2)")).alias("recurring_spend")))


def subscription_totals(subs: DataFrame) -> DataFrame:
    """Per account Σ typical amounts each first rounded to 2, and ×12."""
    typical = F.round(F.col("typical_amount").cast("decimal(20,6)"), 2)
    return (subs.groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("subscriptions"),
                 F.sum(typical).alias("monthly_total"))
            .withColumn("annual_total", F.col("monthly_total") * 12))


def feature_summary(features: DataFrame, names: list[str]) -> DataFrame:
    """Mean / sample std / min / max of each feature, one row per feature.

    One aggregation pass (4·n partial aggregates), then a narrow unpivot.
    """
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}__mean"), F.stddev_samp(n).alias(f"{n}__std"),
                 F.min(n).alias(f"{n}__min"), F.max(n).alias(f"{n}__max")]
    wide = features.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"),
                     F.col(f"{n}__mean").alias("mean"), F.col(f"{n}__std").alias("std"),
                     F.col(f"{n}__min").cast("double").alias("min"),
                     F.col(f"{n}__max").cast("double").alias("max"))
            for i, n in enumerate(names)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rows_by_category(ledger: DataFrame) -> DataFrame:
    """Row count per (canonical) category."""
    return ledger.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def anomaly_scan_summary(scored: DataFrame) -> DataFrame:
    """Per account: scored, flagged, flagged fraction, model version."""
    return (scored.groupBy("account_id", "model_version")
            .agg(F.count(F.lit(1)).alias("scored"),
                 F.count_if(F.col("is_anomaly")).alias("flagged"))
            .withColumn("flagged_fraction", F.col("flagged") / F.col("scored")))


def flagged_in_month(flagged: DataFrame, month: Column) -> DataFrame:
    """Flagged rows of one month, highest score first (rank per account)."""
    from kontor.functions.scan import keyed_running
    return keyed_running(flagged.filter(month_of("posted_date") == month), ["account_id"],
                         [F.desc("score"), F.asc("transaction_id"), F.asc("model_name")], rank_col="rank")
