"""L4 by propagation: after a sync only the account-months that a change can reach are recomputed.

A changed row (its old and its new form) reaches its own month, the next month (whose category changes compare with it)
and, through E1's rule, every month that holds a row of its recurring key (account, merchant, rounded amount); with
`as_of` only such months from its own to as_of - 1 later. A changed score reaches its month. The model (scaler, centroids,
names) is stored and stays as it is.

For the months reached, sums need their own rows and totals those of the month before; E1 needs the rows of their
recurring keys over time. These are taken out of the ledger by semi joins, and all aggregates, joins and hashes run over
them alone, so their cost follows the change; the ledger itself is only scanned.

Defined cases: a month left without rows is reached and has no inputs (its advice goes); null accounts are compared as
equal; no changes reach nothing; a change in a row's id, date, amount, merchant, category or account is two forms of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators import advice, clusters, reports
from kontor.operators.monthly import category_totals, features_from_facts, key_tasks, month_facts
from kontor.operators.recurring import KEY
from kontor.session import cut_lineage

MONTH = ["account_id", "month"]


@dataclass(frozen=True)
class ArchetypeModel:
    """Stored model tables: scaler (H2), centroids (H3) and their names with descriptions (H7)."""

    stats: DataFrame
    centroids: DataFrame
    names: DataFrame

    def archetypes(self, features: DataFrame) -> DataFrame:
        assigned = clusters.assign_cluster(clusters.standardise(features, self.stats), self.centroids)
        names = self.names.select("cluster", F.col("name").alias("archetype"), "description")
        # one row per cluster
        return assigned.join(F.broadcast(names), "cluster").select(*MONTH, "archetype", "description")


def _among(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    return rows.join(keys, [rows[c].eqNullSafe(keys[c]) for c in on], how)


def _keyed(facts: DataFrame) -> DataFrame:
    """Spend rows with E1's key; rows without a whole key can't recur."""
    rows = facts.filter(~F.col("is_inflow")).withColumn("amount_key", F.bround("amount", 0))
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY))


def changed_rows(before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
    """Both forms of the rows with these transaction ids; rows that are alike in both ledgers are no change."""
    ids = ids.select("transaction_id").distinct()
    old, new = (_among(ledger, ids, ["transaction_id"]) for ledger in (before, after))
    return old.exceptAll(new.select(*old.columns)).unionByName(new.exceptAll(old.select(*new.columns)))


def reached_months(ledger: DataFrame, changed: DataFrame, as_of: int | None = None, rescored: DataFrame | None = None,
                   facts: DataFrame | None = None) -> DataFrame:
    """The (account_id, month) that changes reach, each once. ledger: after the change; changed: see `changed_rows`;
    rescored: rows (account_id, month) whose scores changed; facts: the ledger's `month_facts`, if they are written."""
    delta = cut_lineage(month_facts(changed))  # its size is known, so that the ledger stays where it is if it is small
    own = delta.select(*MONTH).distinct()
    reached = own.unionByName(own.select("account_id", F.add_months("month", 1).alias("month")))
    if rescored is not None:
        reached = reached.unionByName(rescored.select(*MONTH))
    # each key and month once on either side, so that a key with many rows is few pairs
    rows = _keyed(month_facts(ledger) if facts is None else facts).select(*KEY, "month")
    moved = _keyed(delta).select(*KEY, F.col("month").alias("_from")).distinct()
    if as_of is None:
        kin = rows.join(moved.drop("_from").distinct(), KEY, "left_semi")
    else:
        later = F.col("month").between(F.col("_from"), F.add_months("_from", as_of - 1))
        kin = _among(rows, moved.drop("_from").distinct(), KEY).distinct().join(moved, KEY).filter(later)
    return reached.unionByName(kin.select(*MONTH)).distinct()


def reached_inputs(ledger: DataFrame, reached: DataFrame, flagged: DataFrame, model: ArchetypeModel, as_of: int | None = None,
                   facts: DataFrame | None = None) -> DataFrame:
    """L1's rows of the reached months, as a full recompute gives them; months without rows have none.
    reached: written `reached_months`; flagged: as in `advice_inputs`, of any months; facts: as in `reached_months`."""
    facts = month_facts(ledger) if facts is None else facts
    near = reached.unionByName(reached.select("account_id", F.add_months("month", -1).alias("month"))).distinct()
    around = cut_lineage(_among(facts, near, MONTH))
    here = _among(around, reached, MONTH)
    tasks = key_tasks(facts)
    kin = (_keyed(facts).select(*KEY, "month", "amount", "n", "canon", "is_inflow").repartition(tasks, *KEY)
           .join(_keyed(here).select(*KEY).repartition(tasks, *KEY).distinct(), KEY, "left_semi"))
    features = cut_lineage(features_from_facts(here, as_of=as_of, kin=kin))
    totals = cut_lineage(category_totals(around))
    own = _among(totals, reached, MONTH)
    return advice.advice_inputs(
        here.select(*MONTH).distinct(), model.archetypes(features), reports.top_categories(None, totals=own),
        _among(reports.category_deltas(None, totals=totals), reached, MONTH), _among(flagged, reached, MONTH),
        reports.month_outflow(None, own), reports.recurring_spend(None, features, own))


def refreshed_cache(cache: DataFrame, reached: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L4 over the reached months alone: (refresh set, cache after it). cache: account_id, month, inputs_hash, source, one row
    per account-month with enough data. Reached months without enough data, or without rows, leave the cache."""
    hashed = advice.inputs_hash(advice.has_enough_data(inputs))
    columns = [*MONTH, "inputs_hash", "source"]
    kept = _among(cache.select(*columns), reached, MONTH, "left_anti")
    return (advice.advice_refresh_set(hashed, _among(cache, reached, MONTH)),
            kept.unionByName(hashed.filter("has_enough_data").select(*columns)))


def refresh_after_sync(before: DataFrame, after: DataFrame, ids: DataFrame, flagged: DataFrame, cache: DataFrame,
                       model: ArchetypeModel, as_of: int | None = None, rescored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From the ids that a sync named to the refresh set and the new cache."""
    changed = cut_lineage(changed_rows(before, after, ids))
    reached = cut_lineage(reached_months(after, changed, as_of, rescored))
    return refreshed_cache(cache, reached, cut_lineage(reached_inputs(after, reached, flagged, model, as_of)))
