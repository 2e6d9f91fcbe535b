"""White space as the two source languages define it, as patterns for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as blank when testing a feed value (no non-breaking spaces),
# and those stripped from a raw category label (non-breaking spaces included).
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
STRIPPED = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(c.rlike(rf"\A{BLANK}*\z"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def sql_blank_to_null(expr: str) -> str:
    """SQL twin of `blank_to_null`."""
    return rf"CASE WHEN NOT regexp_full_match({expr}, '{BLANK}*') THEN {expr} END"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{STRIPPED}+|{STRIPPED}+\z", "")


def sql_strip(expr: str) -> str:
    """SQL twin of `strip`."""
    return rf"regexp_replace({expr}, '\A{STRIPPED}+|{STRIPPED}+\z', '', 'g')"
