"""Pseudorandom permutations of 0..n-1 as Spark column expressions.

The swap-or-not shuffle: in every round a position may trade places with its
mirror image around a keyed point; both decide by the same keyed bit, so each
round, and their composition, is a bijection for any n, with no tables, no
sort and no cycle walking.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 40


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Image of `index` (long, 0 <= index < n) under the permutation of 0..n-1 that `key` names."""
    size = F.greatest(n.cast("long"), F.lit(1).cast("long"))

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(*key, r) - x, size)
        return F.when(F.xxhash64(F.greatest(x, partner), r, *key).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)
