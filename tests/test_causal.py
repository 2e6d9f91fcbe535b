"""Per-transaction causal features: causality, isolation, fallbacks, bursts."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontor.operators import expanding
from kontor.operators.causal import ANOMALY_FEATURES, transaction_features, zscore_flags
from kontor.operators.contracts import finite_check
from kontor.operators.ledger import normalise_ledger


def feats(raw):
    return {r.transaction_id: r for r in transaction_features(normalise_ledger(raw)).collect()}


def test_later_spike_does_not_change_earlier_rows(ledger):
    base = [("2026-05-01", 20), ("2026-05-02", 22), ("2026-05-03", 21)]
    before = feats(ledger(base))
    after = feats(ledger(base + [("2026-05-04", 10000)]))
    for tid, row in before.items():
        assert after[tid].amount_zscore_in_category == pytest.approx(row.amount_zscore_in_category)
    first = before["t00000"]
    assert first.amount_zscore_in_category == 0.0
    assert first.amount_ratio_to_category_median == 1.0
    assert first.days_since_previous == 30.0
    assert first.merchant_novelty == 1.0


def test_accounts_are_isolated(ledger):
    rows = [(f"2026-05-{i + 1:02d}", 10, "A", "dining", 1) for i in range(5)]
    rows += [(f"2026-05-{i + 1:02d}", 5000, "A", "dining", 2) for i in range(5)]
    f = feats(ledger(rows))
    assert all(abs(r.amount_zscore_in_category) < 1 for r in f.values() if r.account_id == 1)


def test_novel_category_splurge(ledger):
    rows = [(f"2026-05-{i + 1:02d}", 20, "Cafe", "dining") for i in range(10)]
    rows.append(("2026-05-12", 1899, "Watch shop", "shopping"))
    last = feats(ledger(rows))["t00010"]
    assert last.amount_zscore_in_category > 3
    assert last.merchant_novelty == 1.0
    assert last.category_rarity == pytest.approx(1.0)


def test_refunds_and_income_not_scored(ledger):
    rows = [(f"2026-05-{i + 1:02d}", 20) for i in range(5)]
    rows += [("2026-05-07", -50, "Shop", "dining"), ("2026-05-08", -3000, "Employer", "income")]
    assert len(feats(ledger(rows))) == 5


def test_card_testing_burst(ledger):
    rows = [(f"2026-05-{i + 1:02d}", 20, "Cafe") for i in range(10)]
    rows += [("2026-05-15", a, "Kiosk", "shopping") for a in (3, 4, 5, 6)]
    raw = ledger(rows)
    f = feats(raw)
    burst = [r for r in f.values() if r.merchant == "Kiosk"]
    assert all(r.merchant_txns_same_day == 4 for r in burst)
    assert all(r.account_txns_same_day == 4 for r in burst)
    flagged = zscore_flags(transaction_features(normalise_ledger(raw))).filter("zscore_flag").count()
    assert flagged == 0


def test_zero_variance_is_finite(ledger):
    raw = ledger([(f"2026-05-{i + 1:02d}", 20) for i in range(10)])
    row = finite_check(transaction_features(normalise_ledger(raw)), ANOMALY_FEATURES).collect()[0]
    assert all(v == 0 for v in row.asDict().values())


def test_same_day_rows_ordered_by_id(ledger):
    raw = ledger([("2026-05-01", 10, "A"), ("2026-05-01", 30, "A"), ("2026-05-01", 50, "B")])
    f = feats(raw)
    assert f["t00000"].merchant_frequency == 0.0
    assert f["t00001"].merchant_frequency == 1.0
    assert f["t00001"].days_since_previous == 0.0
    assert f["t00002"].merchant_txns_same_day == 1.0


@settings(max_examples=5, deadline=None)
@given(st.floats(min_value=0.5, max_value=4.0), st.floats(min_value=0.0, max_value=3.0))
def test_threshold_monotone(spark, lo, delta):
    rows = [("t%02d" % i, 1, f"2026-05-{i + 1:02d}", float(a)) for i, a in
            enumerate([20, 22, 21, 19, 300, 20, 25, 800, 21, 20, 23, 5000])]
    raw = spark.createDataFrame(rows, "transaction_id string, account_id long, d string, amount double").select(
        "transaction_id", "account_id", F.to_date("d").alias("posted_date"),
        F.col("amount").cast("decimal(12,2)").alias("amount"), F.lit("M").alias("merchant"),
        F.lit("dining").alias("category"), F.lit(False).alias("pending"))
    t = transaction_features(normalise_ledger(raw)).cache()
    strict = {r.transaction_id for r in zscore_flags(t, lo + delta).filter("zscore_flag").collect()}
    loose = {r.transaction_id for r in zscore_flags(t, lo).filter("zscore_flag").collect()}
    assert strict <= loose
    assert not math.isnan(lo)


def naive_stats(rows):
    """Every row's features from its account's earlier rows, one by one."""
    out, key = {}, lambda r: (r[2] or "", r[0])
    for account in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == account), key=key)
        for i, (tid, _, day, amount, merchant, category) in enumerate(mine):
            past, of = mine[:i], [float(r[3]) for r in mine[:i] if r[5] == category]
            every = [float(r[3]) for r in past]
            sample = next((s for s in (of, every) if len(s) > 1), None)
            z = (float(amount) - statistics.mean(sample)) / max(statistics.stdev(sample), 1.0) if sample else 0.0
            centre = next((statistics.median(s) for s in (of, every) if s), None)
            gap = (dt.date.fromisoformat(day) - dt.date.fromisoformat(past[-1][2])).days if past and day and past[-1][2] else 30.0
            out[tid] = (z, float(amount) / max(centre, 1.0) if centre else 1.0, sum(r[4] == merchant for r in past), gap,
                        1 - len(of) / max(len(past), 1), sum(r[4] == merchant and r[2] == day for r in mine), sum(r[2] == day for r in mine), int(len(of) >= 5))
    return out


def drifting(n_hot, n_other, seed):
    """One account with most rows, whose amounts drift and repeat, with days that hold many rows; small ones; nulls."""
    rng = random.Random(seed)
    day = lambda i: str(dt.date(2026, 1, 1) + dt.timedelta(days=i))
    rows = []
    for i in range(n_hot):
        amount = rng.choice([20, 20, 35, 5000, round(rng.uniform(1, 50) + (i if i < n_hot / 2 else n_hot - i) / 3, 2)])
        rows.append((f"h{rng.randrange(10**9):09d}{i}", 7, day(rng.choice([i // 9, i // 30 * 3])), amount, rng.choice("ABCD") if i % 50 else f"M{i}",
                     rng.choice(["dining", "dining", "groceries", "travel"]) if i % 41 else None))
    rows += [(f"o{i}", rng.choice([1, 2, 3, None]), day(rng.randrange(40)) if i % 13 else None, round(rng.uniform(1, 90), 2), rng.choice("AB"), "dining") for i in range(n_other)]
    return rows


@pytest.mark.parametrize(("block_rows", "n_hot"), [(17, 260), (90, 400), (10_000, 200)])
def test_hot_account_over_many_blocks(spark, block_rows, n_hot):
    rows = drifting(n_hot, 60, block_rows)
    schema = "transaction_id string, account_id long, d string, a string, merchant string, category string"
    df = spark.createDataFrame([(t, k, d, str(a), m, c) for t, k, d, a, m, c in rows], schema).select(
        "*", F.col("d").cast("date").alias("posted_date"), F.col("a").cast("decimal(12,2)").alias("amount"), F.lit(False).alias("is_inflow"),
        F.trunc(F.col("d").cast("date"), "month").alias("month"), F.lit("own").alias("n"))
    got = transaction_features(df, carry=["n"], block_rows=block_rows)
    want = naive_stats(rows)
    found = {r.transaction_id: r for r in got.collect()}
    assert found.keys() == want.keys()
    for tid, r in found.items():
        mine = (r.amount_zscore_in_category, r.amount_ratio_to_category_median, r.merchant_frequency, r.days_since_previous, r.category_rarity,
                r.merchant_txns_same_day, r.account_txns_same_day, r.has_history)
        assert mine == pytest.approx(want[tid], rel=1e-9), (tid, mine, want[tid])
        assert r.merchant_novelty == (want[tid][2] == 0) and r.n == "own"


def test_blocks_are_bounded(spark, monkeypatch):
    """No task reads more than about a block of the account that holds most rows, nor more carried values than a few blocks."""
    rows = drifting(3000, 30, 1)
    df = spark.createDataFrame([(t, k, d, str(a), m, c) for t, k, d, a, m, c in rows],
                               "transaction_id string, account_id long, d string, a string, merchant string, category string").select(
        "*", F.col("d").cast("date").alias("posted_date"), F.col("a").cast("decimal(12,2)").alias("amount"))
    staged = df.filter("account_id = 7").withColumns({"_key": F.lit("=7"), "_cents": (F.col("amount") * 100).cast("long"), "_day": F.datediff("posted_date", F.lit("1970-01-01"))})
    ranged = expanding.cut_lineage(staged.repartitionByRange(10, "_day", "transaction_id").withColumn("_pid", F.spark_partition_id().cast("long")))
    sizes = [r["count"] for r in ranged.groupBy("_pid").count().collect()]
    carried = [r["n"] for r in expanding._left_behind(ranged).filter("kind IN ('av')").groupBy("_pid").agg(F.sum("n").alias("n")).collect()]
    assert max(sizes) < 3 * 300 and max(carried) < 4 * max(sizes)


def test_blocks_are_read_by_columns():
    """No Python call for each row, and sums beyond 64 bits stay exact."""
    import sys
    import pyarrow as pa
    rng, n = random.Random(4), 600
    for top in (9_000, 10**14):
        days = [rng.choice([None, *range(9)]) for _ in range(n)]
        keys, cats, cents = [rng.choice(["=1", "=2", ""]) for _ in range(n)], [rng.choice(["a", "b", None]) for _ in range(n)], [rng.randrange(1, top) for _ in range(n)]
        rows = pa.table({"_key": keys, "transaction_id": [f"{i:04d}" for i in range(n)], "category": pa.array(cats, pa.string()), "merchant": ["m"] * n,
                         "posted_date": pa.array([None if d is None else dt.date(2026, 1, 1 + d) for d in days], pa.date32()),
                         "_day": pa.array([-2**31 if d is None else d for d in days], pa.int32()), "_cents": pa.array(cents, pa.int64())})
        calls = [0]
        sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call" and "expanding" in frame.f_code.co_filename)))
        try:
            found = expanding.block_stats(rows).to_pylist()
        finally:
            sys.setprofile(None)
        assert calls[0] < n
        past = {}
        for r in found:
            for mean, spread, median, count, name in (("_c_mean", "_c_std", "_c_med", "_c_cnt", (r["_key"], r["category"])), ("_a_mean", "_a_std", "_a_med", "_a_cnt", r["_key"])):
                seen = past.setdefault(name, [])
                assert r[count] == len(seen) and (r[mean] is None) == (not seen) and (r[spread] is None) == (len(seen) < 2)
                if seen:
                    assert r[mean] == sum(seen) / 100 / len(seen) and r[median] == pytest.approx(statistics.median(seen) / 100, rel=1e-15)
                if len(seen) > 1:
                    whole = len(seen) * sum(x * x for x in seen) - sum(seen) ** 2
                    assert r[spread] == math.sqrt(whole / (len(seen) * (len(seen) - 1))) / 100
                seen.append(r["_cents"])


def test_only_wanted_columns_move(spark):
    """Columns that neither the caller nor a statistic needs are not shuffled and not sent to Python and back."""
    rows = drifting(30, 60, 10)
    df = spark.createDataFrame([(t, k, d, str(a), m, c) for t, k, d, a, m, c in rows],
                               "transaction_id string, account_id long, d string, a string, merchant string, category string").select(
        "*", F.col("d").cast("date").alias("posted_date"), F.col("a").cast("decimal(12,2)").alias("amount"), F.lit(False).alias("is_inflow"),
        F.trunc(F.col("d").cast("date"), "month").alias("month"))
    kept = expanding.expanding(df, keep=["transaction_id", "d"])
    assert kept.columns == ["transaction_id", "d", *[f.split()[0] for f in expanding.STATS.split(", ")]]
    plain, hot = transaction_features(df, labels=()), transaction_features(df, labels=(), block_rows=17)
    whole = transaction_features(df).drop("month", "merchant", "category")
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert sorted(map(tuple, plain.collect()), key=repr) == want and len(want) == len(rows)
    assert sorted(map(tuple, hot.collect()), key=repr) == want
    sent, back = plain._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1].split("\n")[0].rsplit("[", 1)
    assert "merchant" in sent and "month" not in sent and " amount#" not in sent
    assert "_amount" in back and "merchant" not in back and "category#" not in back
