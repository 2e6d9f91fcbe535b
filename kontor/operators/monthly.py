"""F: the 14 monthly behaviour features, one row per (account, month).

The ledger is read once, into `month_facts`: its rows with the columns that F and D1 need, written without
a shuffle (counting equal rows first shrinks a ledger by less than one in a hundred). Each part is then an
aggregate of its own with partial aggregation: sums by account-month, distinct merchants, E1 keys by month. Sums run on
exact decimals and become doubles once, so the result does not depend on the order rows arrive
in. An account-month of up to QUANTILE_ROWS rows takes its quantiles in one aggregate; larger ones by running counts
over distinct amounts, so no task holds all their amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.categories import DISCRETIONARY, FIXED_CATEGORY, canonical_category, is_inflow
from kontor.functions.scan import keyed_running
from kontor.operators.ledger import month_of
from kontor.session import cut_lineage

# Model feature order (positional contract of the model tables).
BEHAVIOUR_FEATURES = [
    "txn_count",
    "avg_ticket",
    "ticket_variability",
    "merchant_diversity",
    "weekend_ratio",
    "recurring_share",
    "fixed_share",
    "spend_to_income",
] + [f"share_{c}" for c in DISCRETIONARY]

MIN_TRANSACTIONS = 5
SPEND_TO_INCOME_CAP = 3.0
QUANTILE_ROWS = 100_000
KEY_ROWS = 500_000
FRIDAY = 4  # weekday(): Monday = 0; the monthly weekend is Friday..Sunday


def month_facts(ledger: DataFrame) -> DataFrame:
    """The rows behind F and D1, narrowed to what they read, with their canonical category (`canon`), whether it is an
    inflow, and n, how many ledger rows one stands for: 1. Works on raw and on normalised ledgers."""
    month = [] if "month" in ledger.columns else [month_of("posted_date").alias("month")]
    flag = ["is_recurring"] if "is_recurring" in ledger.columns else []
    known = "is_inflow" in ledger.columns  # normalised: its categories are canonical
    rows = ledger.select("account_id", "category", "merchant", "amount", *flag, *(month or ["month"]), *(["is_inflow"] if known else []),
                         (F.weekday("posted_date") >= FRIDAY).alias("weekend"), F.lit(1).cast("long").alias("n"),
                         (F.col("category") if known else canonical_category("category")).alias("canon"))
    return rows if known else rows.withColumn("is_inflow", is_inflow("canon"))


def category_totals(facts: DataFrame) -> DataFrame:
    """D1's totals (raw categories, inflows included) from the pre-aggregate."""
    return facts.groupBy("account_id", "month", "category").agg(
        F.sum(F.col("amount") * F.col("n")).cast("decimal(22,2)").alias("total"), F.sum("n").alias("txn_count"))


def key_tasks(rows: DataFrame) -> int:
    """How many tasks share the rows of a written table by E1 key: KEY_ROWS each, whatever the session's number of partitions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // KEY_ROWS))


def _recurring_spend(spend: DataFrame, as_of: int | None = None, tasks: int | None = None) -> DataFrame:
    """Discretionary spend on E1-recurring keys per (account, month): E1's rule on sums over a key's rows, then the sums of
    the rows whose key qualifies. With `as_of` a month takes the verdict of itself and the as_of - 1 months before it: sums by
    month, so that a frame has `as_of` rows, slide along the key's months. No ledger row is joined with a verdict.

    A key's hash comes first in the order of rows, so that few comparisons go on to the key's texts. The narrow rows move
    once, to their key's task: few share a key and month, so partial sums would be as many and wider, and the sums would move
    again to their key. Rows that come with `amount_key` are where a join by key left them."""
    from kontor.operators.recurring import KEY, MEAN_FLOOR, MIN_MONTHS, REL_TOLERANCE
    amt, n = F.col("amount").cast("double"), F.col("n")
    named = " AND ".join(f"{c} IS NOT NULL" for c in KEY)
    if "amount_key" not in spend.columns:
        spend = (spend.withColumn("amount_key", F.bround("amount", 0)).filter(named)
                 .select(*KEY, "month", "amount", "n", "disc").repartition(*([tasks] if tasks else []), *KEY))
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*KEY))
    per_key = Window.partitionBy("_h", *KEY)
    if as_of is None:
        # the first of a month's rows counts for the month
        first = hashed(spend).withColumn("_first", (F.row_number().over(per_key.orderBy("month")) == 1)
                                         | ~F.col("month").eqNullSafe(F.lag("month").over(per_key.orderBy("month"))))
        parts = first.select("*", n.alias("_n"), (amt * n).alias("_x"), (amt * amt * n).alias("_xx"), F.when(F.col("disc"), F.col("amount") * n).alias("_d"))
        seen, months = per_key, F.count_if("_first")
    else:
        parts = hashed(spend.groupBy(*KEY, "month")
                       .agg(F.sum("n").alias("_n"), F.sum(amt * n).alias("_x"), F.sum(amt * amt * n).alias("_xx"),
                            F.sum(F.when(F.col("disc"), F.col("amount") * n)).alias("_d")))
        seen, months = per_key.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(1 - as_of, 0), F.count(F.lit(1))
    k = parts.select("account_id", "month", "_d", months.over(seen).alias("months"), F.sum("_n").over(seen).alias("n"),
                     F.sum("_x").over(seen).alias("x"), F.sum("_xx").over(seen).alias("xx"))
    mean = F.col("x") / F.col("n")
    var = F.when(F.col("n") > 1, (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) / (F.col("n") - 1)) \
        .otherwise(F.lit(0.0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    recurring = (F.col("months") >= MIN_MONTHS) & (std <= REL_TOLERANCE * F.greatest(F.abs(mean), F.lit(MEAN_FLOOR)))
    return (k.filter(recurring & F.col("_d").isNotNull()).groupBy("account_id", "month")
            .agg(F.sum("_d").cast("double").alias("_recurring")))


def _quantiles(disc: DataFrame, sizes: DataFrame, qs: tuple[float, ...], limit: int) -> DataFrame:
    """Linear-interpolated quantiles of the amount per (account, month) of `sizes` (written; rows in `_n`): in one
    aggregate up to `limit` rows, by a scan over counts beyond; both are exact."""
    key = ["account_id", "month"]
    found = F.percentile(F.col("amount").cast("double"), F.array(*[F.lit(q) for q in qs]), F.col("n")).alias("_q")
    apart = lambda df: df.select(*key, *[F.col("_q")[i].alias(f"_q{i}") for i in range(len(qs))])
    large = sizes.filter(F.col("_n") > limit).select(*key)
    if large.isEmpty():
        return apart(disc.groupBy(*key).agg(found))
    # at most one account-month for every `limit` rows
    small = disc.join(F.broadcast(large), [disc[k].eqNullSafe(large[k]) for k in key], "left_anti")
    rest = disc.join(F.broadcast(large), [disc[k].eqNullSafe(large[k]) for k in key], "left_semi")
    return apart(small.groupBy(*key).agg(found)).unionByName(_scanned_quantiles(rest, qs))


def _scanned_quantiles(disc: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """The same from counts of distinct amounts.

    The running count is a keyed scan, so an account-month with very many amounts lies in several tasks.
    """
    key = ["account_id", "month"]
    counts = disc.groupBy(*key, "amount").agg(F.sum("n").alias("n"))
    run = keyed_running(counts, key, [F.asc("amount")], {"upto": F.col("n")})
    total = counts.groupBy(*key).agg(F.sum("n").alias("rows"))
    placed = run.join(total, key)
    at = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")),
                                   F.col("amount").cast("double")))
    parts, last = [], F.col("rows") - 1
    for i, q in enumerate(qs):
        low = F.floor(last * q)
        parts += [at(low).alias(f"_lo{i}"), at(F.least(low + 1, last)).alias(f"_hi{i}"),
                  F.first(last * q - low).alias(f"_f{i}")]
    ends = placed.groupBy(*key).agg(*parts)
    return ends.select(*key, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"_q{i}")
                               for i in range(len(qs))])


def monthly_features(ledger: DataFrame, min_transactions: int = MIN_TRANSACTIONS, as_of: int | None = None) -> DataFrame:
    """F1-F14 over a normalised ledger (see `features_from_facts`)."""
    return features_from_facts(cut_lineage(month_facts(ledger)), min_transactions, as_of)


def features_from_facts(facts: DataFrame, min_transactions: int = MIN_TRANSACTIONS, as_of: int | None = None,
                        quantile_rows: int = QUANTILE_ROWS, kin: DataFrame | None = None) -> DataFrame:
    """F1-F14 from written `month_facts`.

    With an `is_recurring` column (E1 already applied) the recurring spend is a conditional sum; without it E1 is computed
    from the facts, over all months or, with `as_of`, over that many months up to each month. Where `facts` hold some
    months only, `kin` has the rows of their E1 keys over all months, with `amount_key`.
    """
    key = ["account_id", "month"]
    canon = lambda df: (df.withColumn("category", F.col("canon"))
                        .withColumn("disc", ~F.col("is_inflow") & (F.col("category") != FIXED_CATEGORY)))
    rows = canon(facts)
    has_flag = "is_recurring" in facts.columns
    spend, disc = ~F.col("is_inflow"), F.col("disc")
    # one exact sum for each row, by all that the features ask of it; the features' sums are over these few
    kinds = ["category", "is_inflow", "disc", "weekend", *(["is_recurring"] if has_flag else [])]
    sums = rows.groupBy(*key, *kinds).agg(F.sum(F.col("amount") * F.col("n")).alias("_sum"), F.sum("n").alias("n"))
    money = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_sum"))), F.lit(0)).cast("double")
    aggs = [money(spend).alias("_spend"), money(disc).alias("_disc"), money(spend & ~disc).alias("_fixed"),
            (-money(F.col("is_inflow"))).alias("_income"),
            F.coalesce(F.sum(F.when(disc, F.col("n"))), F.lit(0)).alias("_n"),
            money(disc & F.col("weekend")).alias("_weekend"),
            *([money(disc & F.col("is_recurring")).alias("_recurring")] if has_flag else []),
            *[money(disc & (F.col("category") == c)).alias(f"_cat_{c}") for c in DISCRETIONARY]]
    g = cut_lineage(sums.groupBy(*key).agg(*aggs).filter(
        (F.col("_n") >= min_transactions) & (F.col("_spend") > 0) & (F.col("_disc") > 0)))
    shops = rows.filter("disc").select(*key, "merchant").filter("merchant IS NOT NULL").distinct() \
        .groupBy(*key).agg(F.count(F.lit(1)).alias("_merchants"))
    g = g.join(shops, key, "left").join(_quantiles(rows.filter("disc"), g, (0.25, 0.5, 0.75), quantile_rows), key)
    if not has_flag:
        recurring = (_recurring_spend(rows.filter(spend), as_of, key_tasks(facts)) if kin is None
                     else _recurring_spend(canon(kin).filter(spend), as_of))
        g = g.join(recurring, key, "left").withColumn("_recurring", F.coalesce("_recurring", F.lit(0.0)))
    median = F.col("_q1")
    feats = [
        F.col("_n").cast("double").alias("txn_count"),
        median.alias("avg_ticket"),
        ((F.col("_q2") - F.col("_q0")) / F.greatest(median, F.lit(1.0))).alias("ticket_variability"),
        (F.coalesce("_merchants", F.lit(0)) / F.col("_n")).alias("merchant_diversity"),
        (F.col("_weekend") / F.col("_disc")).alias("weekend_ratio"),
        (F.col("_recurring") / F.col("_disc")).alias("recurring_share"),
        (F.col("_fixed") / F.col("_spend")).alias("fixed_share"),
        F.when(F.col("_income") > 0,
               F.least(F.col("_spend") / F.col("_income"), F.lit(SPEND_TO_INCOME_CAP)))
         .otherwise(F.lit(1.0)).alias("spend_to_income"),
    ] + [(F.col(f"_cat_{c}") / F.col("_disc")).alias(f"share_{c}") for c in DISCRETIONARY]
    return g.select(*key, *feats)


def require_rows(features: DataFrame) -> DataFrame:
    """Fail like the reference when no account-month survives (one-row probe)."""
    if features.isEmpty():
        raise ValueError("no account-months survived filtering")
    return features


def feature_vector(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """fixed-order dense vector column `features` (pyspark.ml input)."""
    from pyspark.ml.feature import VectorAssembler
    names = names or BEHAVIOUR_FEATURES
    return VectorAssembler(inputCols=names, outputCol="features").transform(
        features.select("account_id", "month", *names)).select("account_id", "month", "features")


NOT_ENOUGH_DATA = "not enough data"


def month_vector_or_reason(features: DataFrame, requested: DataFrame) -> DataFrame:
    """F16: requested (account, month) -> its 14 features, or a reason when absent."""
    f = features.withColumn("_found", F.lit(True))
    j = requested.select("account_id", "month").join(f, ["account_id", "month"], "left")
    return j.select("account_id", "month",
                    *[F.col(n) for n in BEHAVIOUR_FEATURES],
                    F.when(F.col("_found").isNull(), F.lit(NOT_ENOUGH_DATA)).alias("reason"))
