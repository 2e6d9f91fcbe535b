"""Exact global ranks and running sums without a single-partition window.

`Window.orderBy(...)` with no partition moves every row into one task. Here
the rows are range-sorted (distributed), stamped with
`monotonically_increasing_id` (partition index in the upper bits), and the
lineage is cut with a reliable checkpoint so the stamps are stable. Per
partition totals (one row per partition, a size bounded by the partition
count) give each partition its offset; the running value inside a partition
is an ordinary window partitioned by that partition index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.session import cut_lineage

_PID_SHIFT = 33


def global_running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None,
                   rank_col: str = "global_rank") -> DataFrame:
    """Add a 1-based `rank_col` in `order` (must be a total order) and, for each
    `name -> expr` in `sums`, the running sum of expr up to and including the row."""
    sums = sums or {}
    staged = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    stamped = cut_lineage(staged.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    stamped = stamped.withColumn("_pid", F.shiftright("_mid", _PID_SHIFT))
    part = stamped.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                       *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                          *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                            for n in sums])
    local = Window.partitionBy("_pid").orderBy("_mid")
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # `offsets` has one row per partition of the sorted data: bounded, safe to broadcast
    out = stamped.join(F.broadcast(offsets), "_pid").select(
        "*", (F.col("_off") + F.row_number().over(local)).alias(rank_col),
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(running)).alias(n) for n in sums])
    drop = ["_pid", "_mid", "_off"] + [f"_v_{n}" for n in sums] + [f"_o_{n}" for n in sums]
    return out.drop(*drop)


def keyed_running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None,
                  rank_col: str = "key_rank") -> DataFrame:
    """Per-key rank (1-based) and running sums in `order`, without putting a key in one task.

    The global sort is by (keys, order) with a total order, so the range
    partitioner spreads a hot key over many partitions. Offsets come from the
    (partition, key) counts — at most (#partitions + #keys) rows, a hot key
    contributing one row per partition it spans — and the running part is a
    window over (partition, key) inside each partition.
    """
    sums = sums or {}
    staged = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    stamped = cut_lineage(staged.orderBy(*[F.asc(k) for k in keys], *order)
                          .withColumn("_mid", F.monotonically_increasing_id()))
    stamped = stamped.withColumn("_pid", F.shiftright("_mid", _PID_SHIFT))
    part = stamped.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                              *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                          *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = Window.partitionBy("_pid", *keys).orderBy("_mid")
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stamped.join(offsets, [*keys, "_pid"]).select(
        "*", (F.col("_off") + F.row_number().over(local)).alias(rank_col),
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(running)).alias(n) for n in sums])
    drop = ["_pid", "_mid", "_off"] + [f"_v_{n}" for n in sums] + [f"_o_{n}" for n in sums]
    return out.drop(*drop)
