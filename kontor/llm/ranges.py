"""Which range holds a position: an equi-join on coarse buckets instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def in_range(rows: DataFrame, position: str, ranges: DataFrame, start: str, length: str, total: Column) -> DataFrame:
    """Each row joined with the one range [start, start + length) that holds its position.

    The ranges are disjoint and cover 0..total-1. A range is listed under every bucket it
    touches (at most BUCKETS + number of ranges entries), a position falls in one bucket.
    """
    step = F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(BUCKETS)).cast("long"))
    listed = (ranges.filter(F.col(length) > 0)
              .withColumn("_bucket", F.explode(F.sequence(
                  F.floor(F.col(start) / step).cast("long"),
                  F.floor((F.col(start) + F.col(length) - 1) / step).cast("long")))))
    keyed = rows.withColumn("_bucket", F.floor(F.col(position) / step).cast("long"))
    return (keyed.join(listed, "_bucket")
            .filter((F.col(position) >= F.col(start)) & (F.col(position) < F.col(start) + F.col(length)))
            .drop("_bucket"))
