"""Distributed ranks and running sums equal single-window answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kontor.functions.scan import global_running, keyed_running


def test_keyed_running_matches_window_on_a_hot_key(spark):
    # key 0 holds most rows; force several range partitions
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).select(
            F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"),
            ((F.col("id") * 7919) % 1000).alias("v"), F.col("id").alias("id"))
        got = keyed_running(df, ["k"], [F.asc("v"), F.asc("id")], {"cum": F.col("v")}, rank_col="r")
        w = Window.partitionBy("k").orderBy("v", "id")
        want = df.select("id", F.row_number().over(w).alias("r"),
                         F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
        a = {r.id: (r.r, r.cum) for r in got.collect()}
        b = {r.id: (r.r, r.cum) for r in want.collect()}
        assert a == b
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_global_running_ranks(spark):
    df = spark.range(1000).select(((F.col("id") * 31) % 97).alias("v"), F.col("id"))
    got = {r.id: r.g for r in global_running(df, [F.desc("v"), F.asc("id")], rank_col="g").collect()}
    order = sorted(((-((i * 31) % 97), i) for i in range(1000)))
    assert got == {i: n + 1 for n, (_, i) in enumerate(order)}
