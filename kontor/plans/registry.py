"""Registry of the queries exposed through `__spark_entry__`.

Each query is `(spark, sf_dir) -> DataFrame` and runs an operator over the
driver tables (or ledgers Spark derives from them). `flat` is the final
projection that makes results comparable with the DuckDB oracle: dates as ISO
text, decimals and floats as doubles rounded to 6 places, integers as longs,
string arrays joined with '|'. The oracle SQL applies the same projection by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def flat(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fmt = "yyyy-MM-dd" if isinstance(t, T.DateType) else "yyyy-MM-dd HH:mm:ss"
            c = F.date_format(c, fmt)
        elif isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r6(expr: str, places: int = 6) -> str:
    """SQL twin of `flat` for one double expression."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def d10(expr: str) -> str:
    """SQL twin of `flat` for a date expression."""
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"
