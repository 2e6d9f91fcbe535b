"""K: versioned score store and stale fallback, as DataFrame operations.

Parquet tables have no MERGE; an upsert is `old ⟕anti new-keys ∪ latest(new)`.
The anti join lets the planner broadcast the (usually small) new batch and
stream the large stored table; on disk a batch is a run of its own, merged
on read (`write_upsert`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions.scan import keyed_running
from kontor.sources.runs import RunTable, latest

SCORE_KEYS = ["subject_type", "subject_id", "model_name"]
FEATURE_KEYS = ["account_id", "month"]
SUBJECT_MONTH = "MONTH"
SUBJECT_TRANSACTION = "TRANSACTION"

# Fallback notes.
NOTE_STALE = "Scoring service is unavailable — showing the last result I stored."
NOTE_NONE = "Scoring service is unavailable and I have no earlier result for this month"
NOTE_THIN = "Not enough activity this month to identify a pattern"
NOTE_NO_TRANSACTIONS = "No transactions for this account"
NOTE_NOTHING_SCORABLE = "No scorable transactions"
NOTE_STALE_FLAGS = "Scoring service is unavailable — showing previously flagged charges"
HISTORY_MONTHS = 12
SCAN_YEARS = 2


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Replace rows of `old` whose key appears in `new`, insert the rest.

    Within `new`, the row first in `order` wins (default: any, keys unique).
    """
    if order:
        new = latest_per_key(new, keys, order)
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def upsert_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """K1: one row per (account, month); the new computation wins."""
    return upsert(old, new, FEATURE_KEYS)


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """K2: unique (subject_type, subject_id, model_name); other versions stay."""
    return upsert(old, new, SCORE_KEYS, [F.desc("scored_at")])


def latest_score(scores: DataFrame) -> DataFrame:
    """K3: newest score per subject over any model (ties: model name)."""
    return (scores.groupBy("subject_type", "subject_id")
            .agg(F.max_by(F.struct("model_name", "score", "label", "scored_at"),
                          F.struct("scored_at", "model_name")).alias("s"))
            .select("subject_type", "subject_id", "s.*"))


def match_scores_by_id(scored: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: attach results to ledger rows by id (never by position); unknown ids
    are returned separately. Label = ANOMALY / NORMAL."""
    ids = raw.select("transaction_id", "account_id")
    labelled = scored.withColumn("label", F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL"))
    matched = labelled.drop("account_id").join(ids, "transaction_id")
    unknown = labelled.join(ids, "transaction_id", "left_anti")
    return matched, unknown


def flagged_rows(scores: DataFrame, raw: DataFrame) -> DataFrame:
    """TRANSACTION subjects labelled ANOMALY joined to the ledger, one row per model version."""
    fl = scores.filter((F.col("subject_type") == SUBJECT_TRANSACTION) & (F.col("label") == "ANOMALY"))
    return fl.join(raw, fl.subject_id == raw.transaction_id).drop("subject_id")


def flagged_transactions(scores: DataFrame, raw: DataFrame) -> DataFrame:
    """K5: flagged rows ranked by score desc per account."""
    # per-account rank with the keyed scan: a hot account is spread over tasks
    return keyed_running(flagged_rows(scores, raw), ["account_id"],
                         [F.desc("score"), F.asc("transaction_id"), F.asc("model_name")], rank_col="rank")


def with_history(requested: DataFrame, ledger: DataFrame, months: int = HISTORY_MONTHS) -> DataFrame:
    """B9 for requests: the requested (account, month) rows with the number of ledger rows in the
    `months` months up to it. Each request meets at most `months` rows of per-month counts."""
    counts = ledger.groupBy("account_id", F.trunc("posted_date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    return with_counts(requested, counts, months)


def with_counts(requested: DataFrame, counts: DataFrame, months: int = HISTORY_MONTHS) -> DataFrame:
    """`with_history` from the ledger's rows per account and month (account_id, month, rows)."""
    counts = counts.select("account_id", F.col("month").alias("_m"), F.col("rows").alias("_n"))
    spread = requested.select("account_id", "month", F.explode(F.sequence(
        F.add_months("month", 1 - months), F.col("month"), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    seen = (spread.join(counts, ["account_id", "_m"]).groupBy(*FEATURE_KEYS)
            .agg(F.sum("_n").alias("rows_in_window")))
    return (requested.join(seen, FEATURE_KEYS, "left")
            .withColumn("rows_in_window", F.coalesce("rows_in_window", F.lit(0).cast("long"))))


def scores_with_fallback(requested: DataFrame, features: DataFrame, live: DataFrame,
                         stored: DataFrame) -> DataFrame:
    """K6 for (account, month) subjects.

    requested: account_id, month, service_up, rows_in_window (`with_history`); features: the feature
    table; live: this run's scores; stored: the score store.

    no ledger rows in the window   -> null, fresh, "no transactions"
    service up, scored             -> live, fresh
    service up, not scored         -> null, fresh, "not enough activity"
    service down, feature row and a stored score -> last stored, stale, note with its time
    service down otherwise         -> null, stale, "no earlier result"
    """
    f = features.select(*FEATURE_KEYS).withColumn("_has", F.lit(True))
    told = F.col("description") if "description" in live.columns else F.lit(None).cast("string")
    lv = live.select(*FEATURE_KEYS, F.struct(F.col("label").alias("archetype"), told.alias("description"),
                                             F.col("score").cast("double").alias("score"), "model_name").alias("_live"))
    st = (latest_per_key(stored, FEATURE_KEYS, [F.desc("scored_at"), F.asc("model_name")])
          .select(*FEATURE_KEYS, F.struct(F.col("label").alias("archetype"), F.lit(NOTE_STALE).alias("description"),
                                          F.col("score").cast("double").alias("score"), "model_name").alias("_old"),
                  F.col("scored_at").alias("_at")))
    j = (requested.select(*FEATURE_KEYS, "service_up", "rows_in_window").join(f, FEATURE_KEYS, "left")
         .join(lv, FEATURE_KEYS, "left").join(st, FEATURE_KEYS, "left"))
    known = F.col("rows_in_window") > 0
    up = F.col("service_up")
    old = known & ~up & F.col("_has").isNotNull() & F.col("_old").isNotNull()
    answer = F.when(known & up, F.col("_live")).when(old, F.col("_old"))
    note = (F.when(~known, F.lit(NOTE_NO_TRANSACTIONS))
            .when(up & F.col("_live").isNull(), F.lit(NOTE_THIN)).when(up, F.lit(None).cast("string"))
            .when(old, F.concat(F.lit("Last scored "), F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss")))
            .otherwise(F.lit(NOTE_NONE)))
    return j.withColumn("_a", answer).select(*FEATURE_KEYS, "_a.archetype", "_a.description", "_a.score", "_a.model_name",
                                             (known & ~up).alias("stale"), note.alias("note"))


def scan_with_fallback(requested: DataFrame, ledger: DataFrame, live: DataFrame, stored_flags: DataFrame,
                       as_of) -> DataFrame:
    """K6 for the transactions of an account: how many were scored and flagged, and how fresh that is.

    requested: account_id, service_up; ledger: rows of the last SCAN_YEARS years up to `as_of` count;
    live: this run's scores (account_id, is_anomaly, model_version); stored_flags: flagged rows
    of the score store (`flagged_rows`), which are what the answer lists in either case.
    """
    day = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    recent = (ledger.filter((F.col("posted_date") >= F.add_months(day, -12 * SCAN_YEARS))
                            & (F.col("posted_date") <= F.date_add(day, 1)))
              .groupBy("account_id").agg(F.count(F.lit(1)).alias("_rows")))
    now = live.groupBy("account_id").agg(F.count(F.lit(1)).alias("_scored"), F.count_if("is_anomaly").alias("_flagged"),
                                         F.max("model_version").alias("_version"))
    old = stored_flags.groupBy("account_id").agg(F.count(F.lit(1)).alias("_stored"))
    j = (requested.join(recent, "account_id", "left").join(now, "account_id", "left").join(old, "account_id", "left"))
    known, up = F.col("_rows").isNotNull(), F.col("service_up")
    zero = F.lit(0).cast("long")
    return j.select(
        "account_id",
        F.when(known & up, F.coalesce("_scored", zero)).otherwise(zero).alias("scored"),
        F.when(~known, zero).when(up, F.coalesce("_flagged", zero)).otherwise(F.coalesce("_stored", zero)).alias("flagged"),
        F.when(known & up, F.col("_version")).alias("model_version"),
        (known & ~up).alias("stale"),
        F.when(~known, F.lit(NOTE_NO_TRANSACTIONS)).when(~up, F.lit(NOTE_STALE_FLAGS))
        .when(F.col("_scored").isNull(), F.lit(NOTE_NOTHING_SCORABLE)).alias("note"))


def write_upsert(new: DataFrame, path: str, keys: list[str], order: list | None = None) -> int:
    """Persisted upsert: rows of the table at `path` with a key of `new` are replaced, the rest stay.
    How many rows were written.

    The table is one of runs with an atomic manifest (kontor.sources.runs): a job that fails leaves the last
    state readable, and of two writers the later one adds its rows to the other's. Runs are sorted by `keys`,
    so put first what readers filter on. Within `new`, the row first in `order` wins (default: any, keys unique).
    """
    if order:
        new = latest_per_key(new, keys, order)
    return RunTable(new.sparkSession, path, new.schema, keys, latest(keys)).commit(new)


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of a table that `write_upsert` keeps."""
    return RunTable(spark, path, None, keys, latest(keys)).read()
