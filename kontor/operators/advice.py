"""L: deterministic budget advice, one nested row per account-month.

Inputs are assembled from per-(account, month) aggregates that all share the
same key, so the joins are co-partitioned. Only bounded lists are nested
(top 5 categories; at most one delta per category); flagged charges, whose
number grows with the data, are reduced to a count, the largest charge and an
order-free digest. The rule text is pure Column expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.text import is_blank

# Thresholds and sentences of the rule-based advice.
HIGH_CATEGORY_SHARE = 0.30
NOTABLE_INCREASE = 25.0
HIGH_RECURRING_SHARE = 0.15
TRIM_RATE = "0.15"
RECURRING_RATE = "0.25"
NOTHING_FLAGGED = "Nothing in your transactions looked unusual."
NOTHING_UNUSUAL = "Nothing looked unusual in your spending this month."
NO_REASON = "it doesn't match your usual pattern"
FILLERS = [
    ("Set a weekly spending check-in",
     "Reviewing your transactions once a week catches drift before it becomes a habit, "
     "and takes about five minutes."),
    ("Give your largest category a monthly cap",
     "A specific number to stay under is far easier to act on than a general intention to spend less."),
    ("Move one recurring purchase to a cheaper tier",
     "Downgrading a single subscription you rarely use is a one-time action that saves every month afterwards."),
]
SOURCE_RULES = "rules"
SOURCE_NONE = "none"
FLAG_REASON = "its anomaly score of %s is well above the flagging threshold"


def money(c: Column) -> Column:
    """'$' + amount with 2 places HALF_UP, plain notation."""
    return F.concat(F.lit("$"), F.round(c.cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string"))


def percent(fraction: Column) -> Column:
    """Java Math.round(fraction * 100) + '%'."""
    return F.concat(F.floor(fraction * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def flagged_charges(flagged: DataFrame) -> DataFrame:
    """The full list of flagged charges, flat, keyed by (account_id, month), with what the advice shows of each."""
    score3 = F.round(F.col("anomaly_score").cast("decimal(38,6)"), 3).cast("decimal(38,3)").cast("string")
    return flagged.select("account_id", "month", "transaction_id", "merchant", F.col("amount").cast("decimal(38,2)").alias("amount"),
                          F.date_format("posted_date", "yyyy-MM-dd").alias("date"), "anomaly_score", score3.alias("score"),
                          F.array(F.format_string(FLAG_REASON, score3)).alias("reasons"))


def _words32(text: Column) -> Column:
    """The first 32 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")


def advice_inputs(months: DataFrame, archetypes: DataFrame, top: DataFrame, deltas: DataFrame,
                  flagged: DataFrame, outflow: DataFrame, recurring: DataFrame) -> DataFrame:
    """L1: one row per requested (account, month) with every advice input.

    months     (account_id, month)
    archetypes (account_id, month, archetype, description)
    top        D7 rows; deltas D8 rows; flagged (account_id, month, merchant,
               amount, posted_date, anomaly_score, transaction_id): reduced to
               flagged_count, top_flagged and an order-free flagged_digest
    outflow    D9 (account_id, month, total_spend); recurring D10 rows.
    """
    key = ["account_id", "month"]
    t = (top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "category", F.col("amount").cast("decimal(38,2)").alias("amount"),
        F.col("share").alias("share")))).alias("_t"))
        .select(*key, F.transform("_t", lambda e: F.struct(
            e["category"].alias("category"), e["amount"].alias("amount"),
            e["share"].alias("share"))).alias("top_categories")))
    d = (deltas.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("this_month")).alias("_o"), "category",
        F.col("this_month").cast("decimal(38,2)").alias("this_month"),
        F.col("last_month").cast("decimal(38,2)").alias("last_month"),
        "percent_change"))).alias("_d"))
        .select(*key, F.transform("_d", lambda e: F.struct(
            e["category"].alias("category"), e["this_month"].alias("this_month"),
            e["last_month"].alias("last_month"), e["percent_change"].alias("percent_change")))
            .alias("notable_changes")))
    # Flagged charges per account-month can be many: their list stays a flat table
    # (`flagged_charges`). The advice text needs their count and the largest one (earliest in
    # score order on ties); the cache hash needs an order-free digest of the set, with scores
    # at the three places that the inputs show. All are mergeable aggregates (bounded state).
    charge = F.struct("merchant", "amount", "date", "reasons")
    f = flagged_charges(flagged).groupBy(*key).agg(
        F.count(F.lit(1)).alias("flagged_count"),
        F.min_by(charge, F.struct((-F.col("amount")).alias("a"), (-F.col("anomaly_score")).alias("s"),
                                  F.col("transaction_id").alias("i"))).alias("top_flagged"),
        F.sum(_words32(F.concat_ws("|", "transaction_id", "merchant", F.col("amount").cast("string"), "date", "score")))
        .cast("decimal(38,0)").alias("flagged_digest"))
    o = outflow.select(*key, F.col("total_spend").cast("decimal(38,2)").alias("total_spend"))
    r = recurring.select(*key, F.col("recurring_spend").cast("decimal(38,2)").alias("recurring_spend"))
    a = archetypes.select(*key, "archetype", F.col("description").alias("archetype_description"))
    empty = lambda name, typ: F.coalesce(F.col(name), F.array().cast(typ)).alias(name)
    j = (months.select(*key).join(a, key, "left").join(t, key, "left").join(d, key, "left")
         .join(f, key, "left").join(o, key, "left").join(r, key, "left"))
    return j.select(
        *key, F.date_format("month", "yyyy-MM").alias("month_text"), "archetype", "archetype_description",
        empty("top_categories", "array<struct<category:string,amount:decimal(38,2),share:double>>"),
        empty("notable_changes", "array<struct<category:string,this_month:decimal(38,2),"
                                 "last_month:decimal(38,2),percent_change:double>>"),
        F.coalesce("flagged_count", F.lit(0).cast("long")).alias("flagged_count"),
        "top_flagged",
        F.coalesce("flagged_digest", F.lit(0).cast("decimal(38,0)")).alias("flagged_digest"),
        F.coalesce("total_spend", F.lit(0).cast("decimal(38,2)")).alias("total_spend"),
        F.coalesce("recurring_spend", F.lit(0).cast("decimal(38,2)")).alias("recurring_spend"))


def has_enough_data(inputs: DataFrame) -> DataFrame:
    """L2: archetype present and at least one top category."""
    ok = F.col("archetype").isNotNull() & (F.size("top_categories") > 0)
    return inputs.withColumn("has_enough_data", ok) \
        .withColumn("source", F.when(ok, F.lit(SOURCE_RULES)).otherwise(F.lit(SOURCE_NONE)))


INPUT_FIELDS = ["month_text", "archetype", "archetype_description", "top_categories", "notable_changes",
                "flagged_count", "top_flagged", "flagged_digest", "total_spend", "recurring_spend"]


def inputs_text() -> dict[str, Column]:
    """Every input as text of a fixed format (lists are sorted already; null is empty)."""
    listed = lambda name, fields: F.array_join(F.transform(name, lambda e: F.concat_ws(":", *[
        F.format_string(fmt, e[f]) if fmt else e[f].cast("string") for f, fmt in fields])), ";")
    top = F.col("top_flagged")
    text = {name: F.col(name).cast("string") for name in INPUT_FIELDS}
    text["top_categories"] = listed("top_categories", [("category", ""), ("amount", ""), ("share", "%.4f")])
    text["notable_changes"] = listed("notable_changes", [("category", ""), ("this_month", ""), ("last_month", ""), ("percent_change", "%.1f")])
    text["top_flagged"] = F.concat_ws(":", top["merchant"], top["amount"].cast("string"), top["date"], top["reasons"][0])
    return {name: F.coalesce(c, F.lit("")) for name, c in text.items()}


def inputs_hash(inputs: DataFrame) -> DataFrame:
    """L3: SHA-256 hex of the inputs' text."""
    return inputs.withColumn("inputs_hash", F.sha2(F.concat_ws("|", *inputs_text().values()), 256))


def advice_refresh_set(hashed: DataFrame, cache: DataFrame) -> DataFrame:
    """L4: cache hit when (account, month) is cached with the same hash;
    otherwise the row must be regenerated (and then replaces the cache row)."""
    c = cache.select("account_id", "month", F.col("inputs_hash").alias("_cached_hash"),
                     F.col("source").alias("_cached_source"))
    j = hashed.join(c, ["account_id", "month"], "left")
    hit = F.coalesce(F.col("_cached_hash") == F.col("inputs_hash"), F.lit(False))
    return j.withColumn("cached", hit).withColumn("regenerate", ~hit).drop("_cached_hash")


def rule_summary(inputs: DataFrame) -> DataFrame:
    """The summary sentence."""
    arche = F.coalesce(F.lower("archetype"), F.lit("typical"))
    top = F.col("top_categories")[0]
    led = F.when(F.size("top_categories") > 0, F.concat(
        F.lit(", led by "), top["category"], F.lit(" at "), percent(top["share"]),
        F.lit(" of your discretionary spending"))).otherwise(F.lit(""))
    n = F.col("flagged_count")
    tail = F.when(n == 0, F.lit(NOTHING_FLAGGED)).otherwise(F.concat(
        n.cast("string"), F.when(n == 1, F.lit(" charge was")).otherwise(F.lit(" charges were")),
        F.lit(" flagged as unusual.")))
    return inputs.withColumn("summary", F.concat(
        F.lit("Your spending this month looks like a "), arche, F.lit(" pattern"), led, F.lit(". "), tail))


def _rec(title: Column, detail: Column, saving: Column) -> Column:
    return F.struct(title.alias("title"), detail.alias("detail"), saving.cast("double").alias("saving"))


def rule_recommendations(inputs: DataFrame) -> DataFrame:
    """Exactly three, in order: heavy categories, rising categories, recurring
    share, then fixed fillers."""
    def cat_rec(c):
        target = F.round(c["amount"] * F.lit(TRIM_RATE).cast("decimal(4,2)"), 2)
        return F.when(c["share"] >= HIGH_CATEGORY_SHARE, _rec(
            F.concat(F.lit("Trim "), c["category"], F.lit(" spending")),
            F.concat(c["category"], F.lit(" was "), percent(c["share"]),
                     F.lit(" of your discretionary spending ("), money(c["amount"]),
                     F.lit("). Cutting it by 15% would free about "), money(target), F.lit(" a month.")),
            target))

    def delta_rec(d):
        inc = F.round(d["this_month"] - d["last_month"], 2)
        return F.when(d["percent_change"] >= NOTABLE_INCREASE, _rec(
            F.concat(F.lit("Check your rising "), d["category"], F.lit(" costs")),
            F.concat(d["category"], F.lit(" rose "),
                     F.floor(d["percent_change"] + 0.5).cast("bigint").cast("string"),
                     F.lit("% from "), money(d["last_month"]), F.lit(" to "), money(d["this_month"]),
                     F.lit(". Returning to last month's level would save "), money(inc), F.lit(".")),
            inc))

    cats = F.filter(F.transform("top_categories", cat_rec), lambda x: x.isNotNull())
    rises = F.filter(F.transform("notable_changes", delta_rec), lambda x: x.isNotNull())
    total, rec = F.col("total_spend"), F.col("recurring_spend")
    share = F.round(rec / total, 4)
    recurring = F.when((total > 0) & (share >= HIGH_RECURRING_SHARE), F.array(_rec(
        F.lit("Audit your recurring charges"),
        F.concat(money(rec), F.lit(" of your spending is recurring subscriptions — "), percent(share),
                 F.lit(" of the total. Cancelling the ones you no longer use is the easiest saving "
                       "available to you.")),
        F.round(rec * F.lit(RECURRING_RATE).cast("decimal(4,2)"), 2)))).otherwise(
        F.array().cast("array<struct<title:string,detail:string,saving:double>>"))
    fillers = F.array(*[_rec(F.lit(t), F.lit(d), F.lit(0.0)) for t, d in FILLERS])
    return inputs.withColumn("recommendations", F.slice(F.concat(cats, rises, recurring, fillers), 1, 3))


def explain_top_flag(inputs: DataFrame) -> DataFrame:
    """The largest flagged amount (earliest in score order on ties) as a sentence."""
    top = F.col("top_flagged")
    reason = F.when((top["reasons"].isNull()) | (F.size(top["reasons"]) == 0), F.lit(NO_REASON)) \
        .otherwise(F.lower(top["reasons"][0]))
    sentence = F.concat(F.lit("The "), money(top["amount"]), F.lit(" charge at "), top["merchant"],
                        F.lit(" on "), top["date"], F.lit(" was flagged because "), reason, F.lit("."))
    return inputs.withColumn("flagged_charge_explanation",
                             F.when(F.col("flagged_count") == 0, F.lit(NOTHING_UNUSUAL)).otherwise(sentence))


def advice_valid(advice: DataFrame) -> DataFrame:
    """Summary and explanation non-blank; exactly 3 recommendations with
    non-blank title and detail."""
    recs = F.col("recommendations")
    ok = (~is_blank(F.col("summary")) & (F.size(recs) == 3)
          & F.forall(recs, lambda r: ~is_blank(r["title"]) & ~is_blank(r["detail"]))
          & ~is_blank(F.col("flagged_charge_explanation")))
    return advice.withColumn("valid", ok)


def generate_advice(inputs: DataFrame) -> DataFrame:
    """L5-L8 together; rows without enough data get source 'none' and no advice."""
    a = advice_valid(explain_top_flag(rule_recommendations(rule_summary(has_enough_data(inputs)))))
    enough = F.col("has_enough_data")
    return a.select("*", F.when(enough, F.lit(SOURCE_RULES)).otherwise(F.lit(SOURCE_NONE)).alias("advice_source"))


def advice_provenance(advice: DataFrame, refresh: DataFrame) -> DataFrame:
    """Stored source and cached flag per account-month."""
    r = refresh.select("account_id", "month", "cached")
    return advice.select("account_id", "month", F.col("advice_source").alias("source")).join(
        r, ["account_id", "month"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
