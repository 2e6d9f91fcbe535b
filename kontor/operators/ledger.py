"""A: normalisation, feed mapping, validation, feature (de)serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.categories import canonical_category, is_inflow
from kontor.functions.text import blank_to_null, is_blank


def month_of(date_col: Column | str) -> Column:
    """First day of the month as a DATE (trunc, not date_trunc: that is a timestamp)."""
    date_col = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.trunc(date_col, "MM")


def normalise_ledger(raw: DataFrame) -> DataFrame:
    """A2: canonical category, is_inflow, month. Narrow: no shuffle."""
    return (raw.withColumn("category", canonical_category("category"))
               .withColumn("is_inflow", is_inflow("category"))
               .withColumn("month", month_of("posted_date")))


FEED_DEFAULT_MERCHANT = "Unknown"
FEED_DEFAULT_CATEGORY = "OTHER"


def feed_value(name: str) -> Column:
    """One ledger column from raw change-feed columns (the A6 rules)."""
    if name == "posted_date":
        return F.col("date").alias(name)
    if name == "amount":  # through the decimal text form, then scale 2; null if it does not fit the ledger
        return F.col("amount").cast("string").try_cast("decimal(12,2)").alias(name)
    if name == "merchant":
        return F.coalesce(blank_to_null(F.col("merchant_name")), blank_to_null(F.col("name")),
                          F.lit(FEED_DEFAULT_MERCHANT)).alias(name)
    if name == "category":
        return F.coalesce(F.col("primary_category"), F.lit(FEED_DEFAULT_CATEGORY)).alias(name)
    if name == "pending":
        return F.coalesce(F.col("pending"), F.lit(False)).alias(name)
    raise ValueError(name)


def map_feed_record(feed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw change-feed row -> ledger row (account still external).

    merchant = first non-blank of (merchant_name, name, 'Unknown');
    category = primary label else 'OTHER'; pending null -> false;
    amount goes through its decimal text form, then scale 2 (null beyond decimal(12,2),
    so one bad row does not abort the job).
    """
    return feed.select(F.col("transaction_id"), F.col("external_account_id"), *(keep or []),
                       *[feed_value(c) for c in ("posted_date", "amount", "merchant", "category", "pending")])


DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
MONTH_PATTERN = r"^\d{4}-\d{2}$"


def validate_ledger(raw_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: row contract on a text-typed ledger -> (good typed rows, quarantine).

    Checks: required fields present, date matches YYYY-MM-DD and parses, amount
    parses and fits decimal(12,2), pending absent or a boolean. The reason column
    names the first failing check; good rows carry typed columns.
    """
    amount = F.col("amount").try_cast("decimal(12,2)")
    pending = F.col("pending").try_cast("boolean")
    parsed_date = F.try_to_date(F.col("posted_date"), "yyyy-MM-dd")
    reason = (F.when(is_blank(F.col("transaction_id")), "missing transaction_id")
              .when(F.col("account_id").try_cast("long").isNull(), "bad account_id")
              .when(F.col("posted_date").isNull()
                    | ~F.col("posted_date").rlike(DATE_PATTERN)
                    | parsed_date.isNull(), "bad posted_date")
              .when(amount.isNull(), "bad amount")
              .when(F.col("merchant").isNull(), "missing merchant")
              .when(F.col("category").isNull(), "missing category")
              .when(F.col("pending").isNotNull() & pending.isNull(), "bad pending"))
    tagged = raw_text.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).select(
        F.col("transaction_id"),
        F.col("account_id").try_cast("long").alias("account_id"),
        parsed_date.alias("posted_date"),
        amount.alias("amount"),
        F.col("merchant"), F.col("category"),
        F.coalesce(pending, F.lit(False)).alias("pending"))
    bad = tagged.filter(F.col("reason").isNotNull())
    return good, bad


def validate_months(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10 for month requests (account_id, month as text): (account_id, month as date), and the rest
    with a reason: the text must be YYYY-MM and name a month."""
    day = F.try_to_date(F.concat(F.col("month"), F.lit("-01")), "yyyy-MM-dd")
    reason = (F.when(F.col("account_id").isNull(), "missing account_id")
              .when(F.col("month").isNull() | ~F.col("month").rlike(MONTH_PATTERN) | day.isNull(), "bad month"))
    tagged = requests.withColumn("reason", reason)
    return (tagged.filter("reason IS NULL").select("account_id", day.alias("month")),
            tagged.filter("reason IS NOT NULL"))


def pack_features(features: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Feature columns -> one JSON text column `features`."""
    return features.select(*keys, F.to_json(F.struct(*names)).alias("features"))


def unpack_feature(json_col: Column | str, name: str, default: float = 0.0) -> Column:
    json_col = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.coalesce(F.get_json_object(json_col, f"$.{name}").try_cast("double"), F.lit(default))
