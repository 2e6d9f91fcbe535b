"""Connected components of a link table by alternating stars.

Links point from the larger to the smaller node. A round hangs every node's larger neighbours on the
smallest node it knows (large star), then every node and its smaller neighbours on the smallest of
these (small star). Components stay as they are and the links become one star per component, around its
smallest node. The least neighbours are aggregates combined before their shuffle, and no step gathers
a node's neighbours: a hub's links are rows of a join, which adaptive execution splits where they are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.scratch import drop, stored


def large_star(links: DataFrame) -> DataFrame:
    """(node, other), node > other: the larger neighbours of every node with the smallest node it knows."""
    ends = links.union(links.select("other", "node"))
    least = ends.groupBy("node").agg(F.min("other").alias("low"))
    # a row per node and one per link: neither side has a bound for a broadcast
    return (ends.join(least.hint("merge"), "node").filter("other > node")
            .select(F.col("other").alias("node"), F.least("node", "low").alias("other")))


def small_star(links: DataFrame) -> DataFrame:
    """(node, other), node > other, distinct: every node and its smaller neighbours with the smallest of these."""
    least = links.groupBy("node").agg(F.min("other").alias("low"))
    near = links.join(least.hint("merge"), "node").filter("other > low").select(F.col("other").alias("node"), F.col("low").alias("other"))
    return near.union(least.select("node", F.col("low").alias("other"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) but those linked to themselves alone; root is the smallest node reachable."""
    spark = links.sparkSession
    state = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct(), "links")
    before = None
    while True:
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        large = stored(large_star(state), "large-star")
        drop(spark, state)
        state, before = stored(small_star(large), "small-star"), mark
        drop(spark, large)
    roots = state.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct()
    return state.select("node", F.col("other").alias("root")).union(roots)
