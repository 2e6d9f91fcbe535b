"""Uniform shuffle into shards of exact sizes.

The matrix of row counts from input partitions to shards is drawn first: N
tickets are dealt to shards in turn (sizes at most one apart) and permuted
over the N input positions; counting tickets by (partition, shard) gives a
hypergeometric matrix with exactly these margins. Rows are then permuted
inside their partition, the first counts of a partition's row go to shard 0,
the next to shard 1 and so on (the exchange), and positions inside a shard are
permuted again. The permutations are keyed arithmetic, so neither a partition
nor a shard is ever sorted or held by one task.

Defined cases: an empty table gives an empty result; repeated rows are separate
rows; null columns are carried; the input may have any other columns, except
that `shard` and `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.permute import permuted
from kontor.llm.ranges import in_range
from kontor.llm.scratch import stored

SHARDS = 24
SEED = 77
SLOTS_A_TASK = 1 << 16


def count_matrix(parts: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(part, shard, n): how many rows of each partition go to each shard. parts: (part, rows, start)."""
    spark = parts.sparkSession
    tickets = spark.range(total).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        permuted(F.col("id"), F.lit(total), F.lit(seed)).alias("position"))
    dealt = in_range(tickets, "position", parts, "start", "rows", F.lit(total))
    return dealt.groupBy("part", "shard").agg(F.count("*").alias("n"))


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, exchange: bool = True) -> DataFrame:
    """All rows with `shard` (0..shards-1) and `slot` (0.. without gaps in each shard).

    exchange=True also moves the rows: tasks hold runs of slots of one shard, in order.
    """
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # the address of a row is frozen by writing it: both passes below see the same one;
    # inside a struct, the row's own names can't meet those used here
    held = stored(rows.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("_at")), "shard-rows", "zstd")
    held = (held.withColumn("_part", F.shiftright("_at", 33))
            .withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"))
    zero = F.lit(0).cast("long")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(held.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"))
                   .withColumn("start", F.coalesce(F.sum("rows").over(order), zero)), "shard-parts")
    total = parts.agg(F.sum("rows")).first()[0] or 0
    along = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = (stored(count_matrix(parts, total, shards, seed), "shard-matrix")
             .withColumn("from", F.coalesce(F.sum("n").over(along), zero))
             .withColumn("to", F.coalesce(F.sum("n").over(down), zero)))
    # a partition's row of the matrix, one value for each: the rows themselves move once, to their shards
    lanes = stored(cells.groupBy("part").agg(F.collect_list(F.struct("shard", "n", "from", "to")).alias("_cells"))
                   .join(parts, "part").select(F.col("part").alias("_part"), F.col("rows").alias("_rows"), "_cells"), "shard-lanes")
    local = (held.join(lanes, "_part")
             .withColumn("_r", permuted(F.col("_i"), F.col("_rows"), F.lit(seed + 1), F.col("_part"))))
    size = F.floor(F.lit(total) / shards).cast("long") + (F.col("shard") < F.lit(total % shards)).cast("long")
    mine = F.filter("_cells", lambda c: (c["from"] <= F.col("_r")) & (F.col("_r") < c["from"] + c["n"]))[0]
    placed = (local.withColumn("_cell", mine).withColumn("shard", F.col("_cell.shard"))
              .withColumn("_place", F.col("_cell.to") + F.col("_r") - F.col("_cell.from"))
              .withColumn("slot", permuted(F.col("_place"), size, F.lit(seed + 2), F.col("shard"))))
    out = placed.select("row.*", "shard", "slot")
    if not exchange:
        return out
    return (out.repartition("shard", F.floor(F.col("slot") / SLOTS_A_TASK))
            .sortWithinPartitions("shard", "slot"))
