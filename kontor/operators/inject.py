"""Labelled anomaly injection and evaluation-set preparation.

Draws come from md5 of (seed, kind, pick, tag), so they are reproducible in
any engine with md5 (numpy's generator is not replayed). Accounts are chosen
by rank among the eligible accounts; the per-account statistics (median,
anchor date, modal category and merchant, used categories) are computed only
for the picked accounts, as distributed aggregates and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.scan import global_running
from kontor.operators.causal import spend_only
from kontor.session import cut_lineage

# Anomaly kinds, fraud merchant names, candidate novel categories.
ANOMALY_KINDS = ["amount_spike", "novel_category_splurge", "card_testing_burst"]
FRAUD_MERCHANTS = [
    "QuickCash Kiosk", "Global Prepaid Ltd", "Duty Free Terminal 4",
    "Crypto Exchange XYZ", "Luxury Watch Outlet", "Anonymous Gift Cards",
]
NOVEL_CANDIDATES = ["shopping", "entertainment", "transport", "dining"]
MIN_ROWS = 40
ANCHOR_AT = 0.6
BURST_SIZE = 4


def draw(seed: int, kind: Column, pick: Column, tag: str) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(seed|kind|pick|tag)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), kind, pick.cast("string"), F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def inject_anomalies(spend: DataFrame, n_per_kind: int = 8, seed: int = 7) -> DataFrame:
    """Spend rows + labelled injected rows (`is_injected_anomaly`, `anomaly_kind`)."""
    _, injected = drawn(spend, spend_counts(spend), n_per_kind, seed)
    return _unlabelled(spend).unionByName(injected)


def spend_counts(spend: DataFrame) -> DataFrame:
    return spend.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


def _unlabelled(spend: DataFrame) -> DataFrame:
    return spend.select("transaction_id", "account_id", "posted_date", "amount", "merchant", "category",
                        "pending", "is_inflow", "month",
                        F.lit(False).alias("is_injected_anomaly"),
                        F.lit(None).cast("string").alias("anomaly_kind"))


def drawn(spend: DataFrame, counts: DataFrame, n_per_kind: int = 8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The spend rows of the accounts drawn from `counts` (their spend rows), and the rows injected into these. Both are
    written, and so is what they are drawn from: `spend` is read once for rows, whatever many steps follow."""
    spark = spend.sparkSession
    counts = cut_lineage(counts)
    eligible = counts.filter(F.col("n") >= MIN_ROWS)
    ranked = global_running(eligible.select("account_id", "n"), [F.asc("account_id")], rank_col="_acct_rank")
    n_eligible = eligible.count()
    if n_eligible == 0:
        raise ValueError(f"no account has {MIN_ROWS} spend rows to inject into")

    kinds = F.array(*[F.lit(k) for k in ANOMALY_KINDS])
    picks = (spark.range(len(ANOMALY_KINDS) * n_per_kind)
             .select(F.element_at(kinds, (F.col("id") / n_per_kind).cast("int") + 1).alias("kind"),
                     (F.col("id") % n_per_kind).cast("int").alias("i")))
    picks = picks.withColumn("_acct_rank", F.floor(draw(seed, F.col("kind"), F.col("i"), "account")
                                                   * F.lit(n_eligible)).cast("long") + 1)
    # len(ANOMALY_KINDS) * n_per_kind rows, whatever many accounts there are
    picks = cut_lineage(ranked.join(F.broadcast(picks), "_acct_rank").drop("_acct_rank"))

    rows = cut_lineage(spend.join(F.broadcast(picks.select("account_id").distinct()), "account_id", "left_semi"))
    picks, counts = picks.drop("n"), picks.select("account_id", "n").distinct()
    # the date at position floor(0.6 n) of the account's sorted dates, from
    # per-day counts (pre-aggregated, so a huge account never sorts its rows
    # in one task): the first day whose running count passes that position
    per_day = rows.groupBy("account_id", "posted_date").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("account_id").orderBy("posted_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    anchor = (per_day.withColumn("_cum", F.sum("c").over(upto))
              .join(counts, "account_id")
              .filter(F.col("_cum") > F.floor(F.col("n") * ANCHOR_AT))
              .groupBy("account_id").agg(F.min("posted_date").alias("anchor")))
    stats = rows.groupBy("account_id").agg(
        F.percentile(F.col("amount").cast("double"), 0.5).alias("typical"),
        F.collect_set("category").alias("used"))
    cat_counts = rows.groupBy("account_id", "category").agg(F.count(F.lit(1)).alias("c"))
    top_cat = (cat_counts.withColumn("_r", F.row_number().over(
        Window.partitionBy("account_id").orderBy(F.desc("c"), F.asc("category"))))
        .filter("_r = 1").select("account_id", F.col("category").alias("modal_category")))
    merch = (rows.join(top_cat, "account_id").filter(F.col("category") == F.col("modal_category"))
             .groupBy("account_id", "merchant").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("_r", F.row_number().over(
                 Window.partitionBy("account_id").orderBy(F.desc("c"), F.asc("merchant"))))
             .filter("_r = 1").select("account_id", F.col("merchant").alias("modal_merchant")))
    p = (picks.join(anchor, "account_id").join(stats, "account_id")
         .join(top_cat, "account_id").join(merch, "account_id"))

    kind, i = F.col("kind"), F.col("i")
    unused = F.filter(F.array(*[F.lit(c) for c in NOVEL_CANDIDATES]),
                      lambda c: ~F.array_contains(F.col("used"), c))
    unused = F.when(F.size(unused) == 0, F.array(F.lit("shopping"))).otherwise(unused)
    fraud = F.array(*[F.lit(m) for m in FRAUD_MERCHANTS])
    fraud_pick = F.element_at(fraud, F.floor(draw(seed, kind, i, "merchant") * len(FRAUD_MERCHANTS))
                              .cast("int") + 1)
    spike = p.filter(kind == "amount_spike").select(
        F.concat(F.lit("inj-amount_spike-"), i.cast("string")).alias("transaction_id"), "account_id",
        F.date_add("anchor", 2).alias("posted_date"),
        F.round(F.col("typical") * (8.0 + 7.0 * draw(seed, kind, i, "amount")), 2).alias("amount"),
        F.col("modal_merchant").alias("merchant"), F.col("modal_category").alias("category"), "kind")
    novel = p.filter(kind == "novel_category_splurge").select(
        F.concat(F.lit("inj-novel_category_splurge-"), i.cast("string")).alias("transaction_id"),
        "account_id", F.date_add("anchor", 3).alias("posted_date"),
        F.round(F.col("typical") * (12.0 + 13.0 * draw(seed, kind, i, "amount")), 2).alias("amount"),
        fraud_pick.alias("merchant"),
        F.element_at(unused, F.floor(draw(seed, kind, i, "category") * F.size(unused)).cast("int") + 1)
        .alias("category"), "kind")
    burst = (p.filter(kind == "card_testing_burst")
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(BURST_SIZE - 1))).alias("j"))
             .select(F.concat(F.lit("inj-card_testing_burst-"), i.cast("string"), F.lit("-"),
                              F.col("j").cast("string")).alias("transaction_id"),
                     "account_id", F.date_add("anchor", 4).alias("posted_date"),
                     F.round(1.0 + 5.0 * draw(seed, kind, F.concat_ws("-", i.cast("string"),
                                                                     F.col("j").cast("string")), "amount"), 2)
                     .alias("amount"),
                     fraud_pick.alias("merchant"), F.lit("shopping").alias("category"), "kind"))
    injected = (spike.unionByName(novel).unionByName(burst)
                .select("transaction_id", "account_id", "posted_date",
                        F.col("amount").cast("decimal(12,2)").alias("amount"), "merchant", "category",
                        F.lit(False).alias("pending"), F.lit(False).alias("is_inflow"),
                        F.trunc("posted_date", "MM").alias("month"),
                        F.lit(True).alias("is_injected_anomaly"), F.col("kind").alias("anomaly_kind")))
    return rows, cut_lineage(injected)


def prepare_eval_set(ledger: DataFrame, splits: DataFrame, which: str, inject: bool,
                     seed: int = 7, n_per_kind: int = 8, known: DataFrame | None = None) -> DataFrame:
    """Accounts of one split -> spend rows -> inject (optional) -> causal features
    recomputed on the union, so injected rows shift their account's history.

    `known`: the features of every spend row of the ledger as it is, written. A row's features follow from its own account, so
    only the accounts that get rows are computed again; of these rows the columns that `known` has beside features are null.
    """
    from kontor.operators.causal import transaction_features
    acc = splits.filter(F.col("split") == which).select("account_id")
    of_split = lambda df: df.join(acc, "account_id", "left_semi")
    as_is = lambda df: (df.withColumn("is_injected_anomaly", F.lit(False))
                        .withColumn("anomaly_kind", F.lit(None).cast("string")))
    marks = ["is_injected_anomaly", "anomaly_kind"]
    if known is not None and not inject:
        return as_is(of_split(known))
    if known is None:
        spend = spend_only(of_split(ledger))
        return transaction_features(inject_anomalies(spend, n_per_kind, seed) if inject else as_is(spend), carry=marks)
    spend = spend_only(ledger)
    rows, injected = drawn(spend, of_split(spend_counts(spend)), n_per_kind, seed)
    # one account for each pick at most
    met = F.broadcast(injected.select("account_id").distinct())
    anew = transaction_features(_unlabelled(rows).join(met, "account_id", "left_semi").unionByName(injected), carry=marks, labels=())
    return (as_is(of_split(known).join(met, "account_id", "left_anti"))
            .unionByName(anew.select(*[c for c in anew.columns if c in known.columns or c in marks]), allowMissingColumns=True))
