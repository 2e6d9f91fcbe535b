"""Canonical spending categories as Column expressions.

The lookup runs as a literal `map` inside the projection (whole-stage codegen,
no join, no shuffle): 25 keys is a constant-size table, so it travels with the
plan instead of being broadcast as data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import sql_strip, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's vocabulary for equal results).
# Canonical categories, inflow categories, and the raw-label -> canonical map.
# ---------------------------------------------------------------------------
CANONICAL = ["dining", "groceries", "subscriptions", "housing", "transport",
             "shopping", "entertainment", "other"]
INFLOW = ["income", "transfer_in"]
CATEGORY_MAP = {
    "dining": "dining",
    "groceries": "groceries",
    "subscriptions": "subscriptions",
    "housing": "housing",
    "transport": "transport",
    "shopping": "shopping",
    "entertainment": "entertainment",
    "other": "other",
    "income": "income",
    "transfer_out": "transfer_out",
    "transfer_in": "transfer_in",
    "coffee": "dining",
    "rent": "housing",
    "food_and_drink": "dining",
    "general_merchandise": "shopping",
    "rent_and_utilities": "housing",
    "transportation": "transport",
    "travel": "transport",
    "personal_care": "other",
    "general_services": "other",
    "medical": "other",
    "bank_fees": "other",
    "loan_payments": "housing",
    "home_improvement": "housing",
    "government_and_non_profit": "other",
}
# Categories that get a share column.
DISCRETIONARY = ["dining", "groceries", "subscriptions", "transport", "shopping", "entertainment"]
FIXED_CATEGORY = "housing"
UNKNOWN = "other"


def strip_lower(raw: Column) -> Column:
    """Lower-case and strip surrounding white space of any script."""
    return F.lower(strip(raw))


def _category_map() -> Column:
    items = []
    for key, value in CATEGORY_MAP.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def canonical_category(raw: Column | str) -> Column:
    """Raw label -> canonical label; unknown or null -> 'other'. No key begins or ends with white space, so a label found
    as it is needs no stripping: that pattern runs on the others alone."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.element_at(_category_map(), F.lower(raw)), F.element_at(_category_map(), strip_lower(raw)), F.lit(UNKNOWN))


def is_inflow(canonical: Column | str) -> Column:
    canonical = F.col(canonical) if isinstance(canonical, str) else canonical
    return F.coalesce(canonical.isin(*INFLOW), F.lit(False))


def sql_canonical_category(raw_sql: str) -> str:
    """The same lookup as a portable SQL CASE (used by the DuckDB oracle)."""
    key = f"lower({sql_strip(raw_sql)})"
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_MAP.items())
    return f"coalesce(CASE {key} {arms} END, '{UNKNOWN}')"


def sql_is_inflow(canonical_sql: str) -> str:
    return "coalesce(" + canonical_sql + " IN (" + ", ".join(f"'{c}'" for c in INFLOW) + "), false)"
