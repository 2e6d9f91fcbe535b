"""L4 by propagation: what a sync's rows reach, and that recomputing just that equals recomputing everything."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kontor.operators import advice as L
from kontor.operators import clusters as H
from kontor.operators import refresh
from kontor.operators import reports as R
from kontor.operators.ledger import month_of
from kontor.operators.monthly import category_totals, features_from_facts, month_facts
from kontor.session import cut_lineage
from tests.conftest import LEDGER_DDL, d

MONTHS = [f"2026-{m:02d}" for m in range(1, 9)]


def base_rows():
    """Three accounts over eight months; a monthly bill in each, else amounts that never recur."""
    rng, rows = random.Random(5), []
    for account in (1, 2, 3):
        for m in MONTHS:
            rows.append((account, f"{m}-03", "9.99" if account != 3 else "19.99", "Flix", "subscriptions"))
            for k in range(7):
                rows.append((account, f"{m}-{10 + k}", f"{rng.randrange(2_000, 90_000) / 100:.2f}", f"Shop {rng.randrange(5)}",
                             rng.choice(["dining", "groceries", "shopping", "rent"])))
            rows.append((account, f"{m}-25", "-2000.00", "Job", "income"))
    return [(f"t{i:05d}", a, d(day), Decimal(x), shop, cat, False) for i, (a, day, x, shop, cat) in enumerate(rows)]


def flagged_of(ledger):
    return (ledger.filter("amount > 850").withColumn("month", month_of("posted_date")).withColumn("anomaly_score", F.lit(0.9))
            .select("account_id", "month", "merchant", "amount", "posted_date", "anomaly_score", "transaction_id"))


def everything(ledger, model, as_of=None):
    """The full recompute: hash of every account-month."""
    facts = cut_lineage(month_facts(ledger))
    feats, totals = cut_lineage(features_from_facts(facts, as_of=as_of)), cut_lineage(category_totals(facts))
    inputs = L.advice_inputs(totals.select("account_id", "month").distinct(), model.archetypes(feats), R.top_categories(None, totals=totals),
                             R.category_deltas(None, totals=totals), flagged_of(ledger), R.month_outflow(None, totals),
                             R.recurring_spend(None, feats, totals))
    return cut_lineage(L.inputs_hash(L.has_enough_data(inputs)))


def hashes(df):
    return {(r.account_id, f"{r.month:%Y-%m}"): r.inputs_hash for r in df.collect()}


@pytest.fixture(scope="module")
def start(spark):
    ledger = cut_lineage(spark.createDataFrame(base_rows(), LEDGER_DDL))
    cents = H.fixed_centroids(spark, 6)
    return ledger, refresh.ArchetypeModel(cut_lineage(H.fit_scaler(features_from_facts(cut_lineage(month_facts(ledger))))), cents, H.name_clusters(cents))


def reached_set(df):
    return sorted((r.account_id, f"{r.month:%Y-%m}") for r in df.collect())


@pytest.mark.parametrize("as_of", [None, 3])
def test_three_changed_rows(spark, start, as_of):
    before, model = start
    rows = {r[0]: r for r in base_rows()}
    shop = next(r for r in rows.values() if r[1] == 1 and r[2] == d("2026-04-12"))
    bill = next(r for r in rows.values() if r[1] == 2 and r[2] == d("2026-05-03"))
    rows[shop[0]] = (*shop[:3], shop[3] + 400, *shop[4:])                               # amended
    del rows[bill[0]]                                                                   # removed
    rows["new"] = ("new", 3, d("2026-08-30"), Decimal("555.55"), "Once", "dining", False)  # arrived
    after = cut_lineage(spark.createDataFrame(list(rows.values()), LEDGER_DDL))
    ids = spark.createDataFrame([(shop[0],), (bill[0],), ("new",), ("t00000",), ("unknown",)], "transaction_id string")

    changed = refresh.changed_rows(before, after, ids)
    assert sorted(r.transaction_id for r in changed.collect()) == sorted([shop[0], shop[0], bill[0], "new"])
    reached = cut_lineage(refresh.reached_months(after, changed, as_of))
    # the bill recurs: its verdict can turn in every month that holds one (with as_of: from its month on)
    bills = {(2, m) for m in (MONTHS if as_of is None else MONTHS[4:7])}
    assert reached_set(reached) == sorted({(1, "2026-04"), (1, "2026-05"), (3, "2026-08"), (3, "2026-09")} | bills)

    old, new = everything(before, model, as_of), everything(after, model, as_of)
    now = hashes(new)
    turned = {k for k in now if hashes(old).get(k) != now[k]}
    assert turned and turned <= set(reached_set(reached))
    got = cut_lineage(refresh.reached_inputs(after, reached, flagged_of(after), model, as_of))
    assert hashes(L.inputs_hash(got)) == {k: now[k] for k in now if k in set(reached_set(reached))}

    cache = old.filter("has_enough_data").select("account_id", "month", "inputs_hash", "source")
    todo, cached = refresh.refresh_after_sync(before, after, ids, flagged_of(after), cache, model, as_of)
    assert {(r.account_id, f"{r.month:%Y-%m}") for r in todo.filter("regenerate").collect()} == turned
    assert hashes(cached) == hashes(new.filter("has_enough_data"))


def test_months_that_empty_and_scores_that_change(spark, start):
    before, model = start
    after = cut_lineage(before.filter("NOT (account_id = 3 AND posted_date >= '2026-08-01')"))
    gone = before.filter("account_id = 3 AND posted_date >= '2026-08-01'").select("transaction_id")
    cache = everything(before, model).filter("has_enough_data").select("account_id", "month", "inputs_hash", "source")
    todo, cached = refresh.refresh_after_sync(before, after, gone, flagged_of(after), cache, model)
    assert (3, "2026-08") not in {(r.account_id, f"{r.month:%Y-%m}") for r in todo.collect()}
    assert hashes(cached) == hashes(everything(after, model).filter("has_enough_data"))
    rescored = spark.createDataFrame([(1, d("2026-02-01"))], "account_id long, month date")
    assert reached_set(refresh.reached_months(before, before.limit(0), rescored=rescored)) == [(1, "2026-02")]


def test_recurring_share_of_any_size(spark):
    """Refunds can leave next to no discretionary spend: the share is then far beyond 1."""
    month = d("2026-04-01")
    totals = spark.createDataFrame([(a, month, "dining", Decimal("100.00")) for a in (1, 2, 3, 4)], "account_id long, month date, category string, total decimal(22,2)")
    feats = spark.createDataFrame([(1, month, -129.4124183006536), (2, month, 0.123456789), (3, month, 2.5e8)], "account_id long, month date, recurring_share double")
    got = {r.account_id: r.recurring_spend for r in R.recurring_spend(None, feats, totals).collect()}
    assert got == {1: Decimal("-12941.24"), 2: Decimal("12.35"), 3: Decimal("25000000000.00"), 4: Decimal("0.00")}


def test_nothing_changed_and_nulls(spark, start):
    before, model = start
    none = refresh.reached_months(before, refresh.changed_rows(before, before, before.select("transaction_id")))
    assert none.count() == 0
    assert refresh.reached_inputs(before, cut_lineage(none), flagged_of(before), model).count() == 0
    odd = cut_lineage(spark.createDataFrame([("n1", None, d("2026-03-04"), Decimal("5.00"), None, None, None)], LEDGER_DDL))
    reached = cut_lineage(refresh.reached_months(before.unionByName(odd), odd))
    assert [(r.account_id, f"{r.month:%m}") for r in reached.orderBy("month").collect()] == [(None, "03"), (None, "04")]
    got = refresh.reached_inputs(before.unionByName(odd), reached, flagged_of(before), model).collect()
    assert [(r.account_id, r.archetype) for r in got] == [(None, None)]


@pytest.mark.parametrize("as_of", [None, 3])
def test_written_facts_stand_for_the_ledger(spark, start, as_of):
    """With the facts at hand neither step reads the ledger's rows again."""
    before, model = start
    facts, changed = cut_lineage(month_facts(before)), before.filter("transaction_id = 't00003'")
    reached = cut_lineage(refresh.reached_months(before, changed, as_of))
    unread = before.withColumn("amount", F.raise_error(F.lit("read again")).cast("decimal(12,2)"))
    assert reached_set(refresh.reached_months(unread, changed, as_of, facts=facts)) == reached_set(reached) != []
    want = refresh.reached_inputs(before, reached, flagged_of(before), model, as_of)
    got = refresh.reached_inputs(unread, reached, flagged_of(before), model, as_of, facts=facts)
    assert hashes(L.inputs_hash(got)) == hashes(L.inputs_hash(want)) != {}
