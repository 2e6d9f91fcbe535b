"""Ledgers derived from the driver tables (the tables hold no bank ledger).

Both ledgers are plain projections/joins of the driver tables, so their size
grows with the scale factor. The same definitions exist as SQL text
(`EVENTS_LEDGER_SQL`, `CATALOGUE_LEDGER_SQL`) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.sources.tables import LEDGER_COLUMNS, table


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` -> one ledger row per event (single calendar month)."""
    # k is a column of a step of its own, so that each row's text is parsed once for all that it decides
    ev = table(spark, sf_dir, "events").withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    category = (F.when(F.col("event_type") == "signup", "Income")
                .when(k % 10 == 0, "Rent")
                .when(F.col("event_type") == "view", "Groceries")
                .when(F.col("event_type") == "click", "Coffee")
                .when(F.col("event_type") == "purchase", "GENERAL_MERCHANDISE")
                .when(F.col("event_type") == "error", "BANK_FEES"))
    negate = (F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (k % 7 == 0))
    amount = F.when(negate, -F.col("value")).otherwise(F.col("value"))
    return ev.select(
        # 19 digits hold every BIGINT id whole, and the text orders like the number
        F.lpad(F.col("event_id").cast("string"), 19, "0").alias("transaction_id"),
        F.col("user_id").cast("long").alias("account_id"),
        F.col("ts").cast("date").alias("posted_date"),
        amount.cast("decimal(12,2)").alias("amount"),
        F.concat(F.lit("m"), k.cast("string")).alias("merchant"),
        category.alias("category"),
        (F.col("event_id") % 20 == 0).alias("pending"),
    )


# Brand number -> raw category label of the catalogue ledger.
BRAND_CATEGORIES = [
    (1, 4, "FOOD_AND_DRINK"),
    (5, 8, "Groceries"),
    (9, 11, "Subscriptions"),
    (12, 13, "RENT_AND_UTILITIES"),
    (14, 16, "transportation"),
    (17, 19, "GENERAL_MERCHANDISE"),
    (20, 21, "Entertainment"),
    (22, 22, " Coffee "),
    (23, 23, "TRANSFER_IN"),
    (24, 24, "transfer_out"),
    (25, 25, "SOMETHING_NEW"),
]
INFLOW_BRAND = 23


def catalogue_ledger(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ part -> a many-month ledger.

    variant 'brand_merchant' uses the brand as merchant (many prices per
    merchant); 'region_year' keys by region and the order year (repeat charges
    in one month). Join strategy is left to Catalyst/AQE: every side here grows
    with the scale factor, so no side is forced into a broadcast.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # what a part decides is derived once for the part and not for each of its lines
    brand = F.col("_brand")
    category = None
    for lo, hi, label in BRAND_CATEGORIES:
        cond = brand.between(lo, hi)
        category = F.when(cond, label) if category is None else category.when(cond, label)
    price = F.col("p_retailprice")
    pa = (table(spark, sf_dir, "part").withColumn("_brand", F.substring_index("p_brand", "#", -1).cast("int"))
          .select("p_partkey", "p_brand", category.alias("category"),
                  F.when(brand == INFLOW_BRAND, -price).otherwise(price).cast("decimal(12,2)").alias("amount")))
    # orders meet their customers first, so that lineitem, the largest table, takes part in two joins and not in three
    j = (li.join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey)
         .join(pa, li.l_partkey == pa.p_partkey))
    tid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("l_quantity").cast("bigint"),
                      F.col("l_shipdate").cast("date"))
    account = F.col("c_nationkey").cast("long")
    posted = F.col("o_orderdate").cast("date")
    merchant = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    if variant == "brand_merchant":
        merchant = F.col("p_brand")
    elif variant == "region_year":
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        j = j.join(nation, j.c_nationkey == nation.n_nationkey)
        account = F.col("n_regionkey").cast("long")
        posted = F.trunc(F.col("o_orderdate").cast("date"), "year")
    elif variant != "base":
        raise ValueError(f"unknown variant {variant!r}")
    return j.select(
        tid.alias("transaction_id"),
        account.alias("account_id"),
        posted.alias("posted_date"),
        "amount",
        merchant.alias("merchant"),
        "category",
        (F.col("l_linenumber") == 1).alias("pending"),
    ).select(*LEDGER_COLUMNS)


EVENTS_LEDGER_SQL = """
SELECT lpad(CAST(event_id AS VARCHAR), 19, '0') AS transaction_id,
       CAST(user_id AS BIGINT) AS account_id,
       CAST(ts AS DATE) AS posted_date,
       CAST(CASE WHEN event_type = 'signup'
                   OR (event_type = 'error' AND k % 7 = 0) THEN -value ELSE value END
            AS DECIMAL(12,2)) AS amount,
       'm' || CAST(k AS VARCHAR) AS merchant,
       CASE WHEN event_type = 'signup' THEN 'Income'
            WHEN k % 10 = 0 THEN 'Rent'
            WHEN event_type = 'view' THEN 'Groceries'
            WHEN event_type = 'click' THEN 'Coffee'
            WHEN event_type = 'purchase' THEN 'GENERAL_MERCHANDISE'
            WHEN event_type = 'error' THEN 'BANK_FEES' END AS category,
       event_id % 20 = 0 AS pending
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
"""


def _catalogue_sql(variant: str = "base") -> str:
    arms = " ".join(f"WHEN b BETWEEN {lo} AND {hi} THEN '{label}'"
                    for lo, hi, label in BRAND_CATEGORIES)
    account, posted, merchant, extra = ("CAST(c_nationkey AS BIGINT)",
                                        "CAST(o_orderdate AS DATE)",
                                        "'part-' || CAST(l_partkey AS VARCHAR)", "")
    if variant == "brand_merchant":
        merchant = "p_brand"
    elif variant == "region_year":
        account = "CAST(n_regionkey AS BIGINT)"
        posted = "CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE)"
        extra = "JOIN nation ON c_nationkey = n_nationkey"
    return f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(l_quantity AS BIGINT), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS transaction_id,
       {account} AS account_id,
       {posted} AS posted_date,
       CAST(CASE WHEN b = {INFLOW_BRAND} THEN -p_retailprice ELSE p_retailprice END
            AS DECIMAL(12,2)) AS amount,
       {merchant} AS merchant,
       CASE {arms} END AS category,
       l_linenumber = 1 AS pending
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN (SELECT *, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b FROM part) p
  ON l_partkey = p_partkey
{extra}
"""


CATALOGUE_LEDGER_SQL = _catalogue_sql("base")
CATALOGUE_BRAND_SQL = _catalogue_sql("brand_merchant")
CATALOGUE_REGION_YEAR_SQL = _catalogue_sql("region_year")
