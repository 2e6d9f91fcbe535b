"""Categories, recurring rules and monthly features on tiny ledgers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kontor.functions.categories import canonical_category
from kontor.operators.ledger import normalise_ledger
from kontor.operators.monthly import monthly_features, require_rows
from kontor.operators.recurring import find_subscriptions, flag_recurring


def features(raw):
    return monthly_features(flag_recurring(normalise_ledger(raw))).collect()


def test_canonical_category(spark):
    df = spark.createDataFrame([("Groceries",), ("  Coffee \t",), ("FOOD_AND_DRINK",), ("SOMETHING_NEW",),
                                (None,), ("transfer_out",), ("TRANSFER_IN",)], "c string")
    got = [r[0] for r in df.select(canonical_category("c")).collect()]
    assert got == ["groceries", "dining", "dining", "other", "other", "transfer_out", "transfer_in"]


def test_subscription_is_recurring(ledger):
    raw = ledger([("2026-01-03", 15.49, "Netflix", "subscriptions"),
                  ("2026-02-03", 15.49, "Netflix", "subscriptions"),
                  ("2026-03-03", 15.49, "Netflix", "subscriptions")])
    assert all(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())


def test_two_months_not_recurring(ledger):
    raw = ledger([("2026-01-03", 15.49, "Netflix"), ("2026-02-03", 15.49, "Netflix")])
    assert not any(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())


def test_varying_amounts_not_recurring(ledger):
    raw = ledger([("2026-01-03", 22.00, "Cafe"), ("2026-02-03", 61.00, "Cafe"), ("2026-03-03", 39.50, "Cafe")])
    assert not any(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())


def test_payroll_never_recurring(ledger):
    raw = ledger([(f"2026-0{m}-01", -2150, "Employer", "Income") for m in (1, 2, 3)])
    assert not any(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())


def test_weekend_ratio_friday_to_sunday(ledger):
    # 15-19 May 2026: Fri, Sat, Sun, Mon, Tue
    raw = ledger([("2026-05-15", 100), ("2026-05-16", 100), ("2026-05-17", 100),
                  ("2026-05-18", 50), ("2026-05-19", 50)])
    (row,) = features(raw)
    assert row.weekend_ratio == pytest.approx(0.75)


def test_avg_ticket_is_median(ledger):
    raw = ledger([("2026-05-0%d" % i, a) for i, a in enumerate([10, 10, 10, 10, 5000], start=1)])
    (row,) = features(raw)
    assert row.avg_ticket == pytest.approx(10.0)


def test_shares_sum_to_one(ledger):
    cats = ["dining", "groceries", "transport", "shopping", "entertainment"]
    raw = ledger([(f"2026-05-0{i + 1}", 100, "M", c) for i, c in enumerate(cats)])
    (row,) = features(raw)
    total = sum(row[f"share_{c}"] for c in cats) + row.share_subscriptions
    assert total == pytest.approx(1.0)


def test_rent_month(ledger):
    raw = ledger([("2026-05-01", 1000, "Landlord", "Rent")] +
                 [(f"2026-05-0{i}", 100, f"R{i}", "dining") for i in range(2, 7)])
    (row,) = features(raw)
    assert row.fixed_share == pytest.approx(1000 / 1500)
    assert row.share_dining == pytest.approx(1.0)
    assert row.txn_count == 5


def test_spend_to_income(ledger):
    raw = ledger([("2026-05-01", -3000, "Employer", "income")] +
                 [(f"2026-05-0{i}", 100, f"R{i}") for i in range(2, 7)])
    (row,) = features(raw)
    assert row.spend_to_income == pytest.approx(500 / 3000)


def test_thin_month_dropped(ledger):
    raw = ledger([("2026-05-01", 10), ("2026-05-02", 12)])
    f = monthly_features(flag_recurring(normalise_ledger(raw)))
    assert f.count() == 0
    with pytest.raises(ValueError):
        require_rows(f)


def test_merchant_diversity(ledger):
    raw = ledger([("2026-05-01", 10, "A"), ("2026-05-02", 10, "A"), ("2026-05-03", 10, "B"),
                  ("2026-05-04", 10, "C"), ("2026-05-05", 10, "D")])
    (row,) = features(raw)
    assert row.merchant_diversity == pytest.approx(0.8)


def test_subscriptions_reject_daily_habit(ledger):
    # coffee every few days: recurring by E1 (3+ months, stable) but fails the E2 cadence check
    rows = [(f"2026-0{m}-{d:02d}", 4.50, "Blue Bottle", "Coffee") for m in (1, 2, 3) for d in (3, 10, 17)]
    raw = ledger(rows)
    assert find_subscriptions(raw).count() == 0
    assert all(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())


def test_subscriptions_dominance(ledger):
    rows = [(f"2026-0{m}-03", 70.04, "Grocer", "Groceries") for m in (1, 2, 3)]
    rows += [(f"2026-0{m}-{d:02d}", 30 + d, "Grocer", "Groceries") for m in (1, 2, 3) for d in (5, 9, 13, 20)]
    rows += [(f"2026-0{m}-15", 15.49, "Netflix", "Subscriptions") for m in (1, 2, 3)]
    subs = {r.merchant: r for r in find_subscriptions(ledger(rows)).collect()}
    assert set(subs) == {"Netflix"}
    assert subs["Netflix"].months_seen == 3
    assert subs["Netflix"].typical_amount == pytest.approx(15.49)


def test_half_even_amount_key(ledger):
    # 2.50 and 3.50 round half-even to 2 and 4: different keys, so never one recurring group
    raw = ledger([("2026-01-03", 2.50, "X"), ("2026-02-03", 3.50, "X"), ("2026-03-03", 2.50, "X")])
    assert not any(r.is_recurring for r in flag_recurring(normalise_ledger(raw)).collect())
    assert raw.select(F.bround("amount", 0).alias("k")).collect()[1].k == 4


def test_recurring_share_paths_agree(spark):
    """F with E1 as a row flag and F with E1 as pre-aggregated sums agree."""
    from kontor.plans.common import catalogue
    led = normalise_ledger(catalogue(spark, "/root/testdata/sf0.001"))
    a = {(r.account_id, r.month): r.recurring_share for r in monthly_features(flag_recurring(led)).collect()}
    b = {(r.account_id, r.month): r.recurring_share for r in monthly_features(led).collect()}
    assert a.keys() == b.keys()
    assert any(v > 0 for v in a.values())
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_strip_is_unicode_aware(spark):
    df = spark.createDataFrame([("\u00a0Groceries\u2003",), ("\u3000coffee\n",)], "c string")
    assert [r[0] for r in df.select(canonical_category("c")).collect()] == ["groceries", "dining"]


def test_as_of_features_ignore_later_months(ledger):
    """A request for March sees the twelve months up to March; what comes later changes nothing."""
    from kontor.plans.flows import features_as_of
    rows = [(f"2026-0{m}-03", 15.49, "Netflix", "subscriptions") for m in (1, 2, 3)]
    rows += [(f"2026-03-{d:02d}", 10 + d, f"Shop {d}", "dining") for d in (5, 9, 13, 20)]
    later = [(f"2026-0{m}-{d:02d}", 10 + d, "Shop 5", "dining") for m in (4, 5, 6) for d in (5, 5, 5, 5, 5)]
    pick = lambda raw: [tuple(r) for r in features_as_of(raw).collect() if str(r.month) == "2026-03-01"]
    before = pick(ledger(rows))
    assert len(before) == 1 and before[0][2 + 5] > 0  # the subscription is recurring as of March
    assert pick(ledger(rows + later)) == before


def test_quantiles_of_a_hot_month(spark):
    """One account-month with half of all rows and many equal amounts, against numpy."""
    import numpy as np
    from decimal import Decimal
    rng = np.random.default_rng(4)
    rows = []
    for account, n in ((1, 3000), (2, 40), (3, 7)):
        for i in range(n):
            amount = 9.99 if rng.random() < 0.4 else round(float(rng.uniform(1, 90)), 2)
            rows.append((f"{account}-{i}", account, "2026-05-04", Decimal(str(amount)), f"m{i % 9}", "dining", False))
    raw = spark.createDataFrame(rows, "transaction_id string, account_id long, posted_date string, amount decimal(12,2), "
                                      "merchant string, category string, pending boolean")
    raw = raw.withColumn("posted_date", F.col("posted_date").cast("date"))
    for r in monthly_features(normalise_ledger(raw)).collect():
        x = [float(a[3]) for a in rows if a[1] == r.account_id]
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        assert r.avg_ticket == pytest.approx(q2) and r.ticket_variability == pytest.approx((q3 - q1) / max(q2, 1))
        assert r.merchant_diversity == pytest.approx(len({a[4] for a in rows if a[1] == r.account_id}) / len(x))


def test_csv_columns_by_name(spark, tmp_path):
    """A1: files with columns in another order, or more of them; one without a needed column is an error."""
    from kontor.sources.files import read_ledger_csv
    (tmp_path / "a.csv").write_text("account_id,transaction_id,posted_date,extra,amount,merchant,category,pending\n"
                                    '7,t1,2026-05-01,x,1.50,"A, ""B""\nC",dining,true\n')
    (tmp_path / "b.csv").write_text("transaction_id,account_id,posted_date,amount,merchant,category,pending\nt2,8,2026-05-02,oops,M,rent,false\n")
    (tmp_path / "c.csv").write_text("transaction_id,account_id\nt3,9\n")
    got = {r.transaction_id: r for r in read_ledger_csv(spark, [str(tmp_path / f) for f in ("a.csv", "none.csv", "b.csv")]).collect()}
    assert got["t1"].account_id == 7 and got["t1"].merchant == 'A, "B"\nC' and str(got["t1"].amount) == "1.50" and got["t1"].pending
    assert got["t2"].account_id == 8 and got["t2"].amount is None
    with pytest.raises(ValueError):
        read_ledger_csv(spark, [str(tmp_path / "c.csv")])
    with pytest.raises(FileNotFoundError):
        read_ledger_csv(spark, [str(tmp_path / "none.csv")])


def test_validation_rejects_overflow_and_bad_booleans(spark):
    from kontor.operators.ledger import validate_ledger, validate_months
    ddl = "transaction_id string, account_id string, posted_date string, amount string, merchant string, category string, pending string"
    rows = [("a", "1", "2026-05-01", "99999999999.99", "m", "c", "true"), ("b", "1", "2026-05-01", "1.00", "m", "c", "maybe"),
            ("c", "1", "2026-05-01", "1.005", "m", "c", None), ("d", "1", "2026-05-01", "NaN", "m", "c", "false"), ("\t", "1", "2026-05-01", "1", "m", "c", "false")]
    good, bad = validate_ledger(spark.createDataFrame(rows, ddl))
    assert {r.transaction_id: r.reason for r in bad.collect()} == {"a": "bad amount", "b": "bad pending", "d": "bad amount", "\t": "missing transaction_id"}
    assert [(r.transaction_id, str(r.amount), r.pending) for r in good.collect()] == [("c", "1.01", False)]
    good, bad = validate_months(spark.createDataFrame([(1, "2026-05"), (1, "2026-13"), (1, "2026-5"), (None, "2026-05"), (2, None)], "account_id long, month string"))
    assert [str(r.month) for r in good.collect()] == ["2026-05-01"] and bad.count() == 4


def test_ids_never_shorten(spark):
    """Event ids beyond twelve digits stay different."""
    from kontor.sources import fixtures
    from kontor.sources.fixtures import events_ledger
    import datetime as dt
    import tempfile
    rows = [(1234567890123, dt.datetime(2026, 5, 1), 1, "view", 1.0, '{"k": 1}'), (1234567890124, dt.datetime(2026, 5, 1), 1, "view", 1.0, '{"k": 1}')]
    where = tempfile.mkdtemp(dir="/tmp")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{where}/events.parquet")
    ids = [r.transaction_id for r in events_ledger(spark, where).collect()]
    assert sorted(ids) == ["0000001234567890123", "0000001234567890124"] and fixtures


def test_large_account_months_take_scanned_quantiles(ledger):
    """Quantiles by one aggregate and by the scan over counts are equal, whichever rows go which way."""
    from kontor.operators.ledger import normalise_ledger
    from kontor.operators.monthly import features_from_facts, month_facts
    from kontor.session import cut_lineage
    rows = [(f"2026-0{m}-{1 + i % 28:02d}", [5, 5, 7.5, 20, 31.25][(i * m) % 5] + i % 3, f"M{i % 4}", "dining", m) for m in (3, 4, 5) for i in range(9 * m)]
    facts = cut_lineage(month_facts(normalise_ledger(ledger(rows))))
    got = [sorted(map(tuple, features_from_facts(facts, quantile_rows=limit).collect())) for limit in (10**6, 30, 0)]
    assert len(got[0]) == 3 and got[0] == got[1] == got[2]


def test_recurring_spend_moves_rows_once(spark, ledger):
    """E1's sums by key and month and its verdicts by key share one exchange; the last one is by account and month."""
    from kontor.operators.monthly import _recurring_spend, month_facts
    facts = month_facts(normalise_ledger(ledger([(f"2026-0{m}-03", 15.49, "Netflix", "subscriptions") for m in (1, 2, 3)])))
    found = _recurring_spend(facts.withColumn("disc", ~F.col("is_inflow")).filter("NOT is_inflow"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2, plan
    assert sorted((f"{r.month:%m}", r._recurring) for r in found.collect()) == [("01", 15.49), ("02", 15.49), ("03", 15.49)]


def test_events_ledger_parses_a_row_once(spark, tmp_path):
    from kontor.sources.fixtures import events_ledger
    rows = [(i, f"2024-01-0{1 + i % 9} 10:00:00", i % 3, ("signup", "view", "click", "purchase", "error", "else")[i % 6], 1.5 * i, '{"k": %d}' % i) for i in range(70)]
    (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
     .selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet"))
    led = events_ledger(spark, str(tmp_path))
    assert led._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
    by = {int(r.transaction_id): r for r in led.collect()}
    assert [by[i].category for i in (0, 10, 7, 8, 9, 4, 5)] == ["Income", "Rent", "Groceries", "Coffee", "GENERAL_MERCHANDISE", "BANK_FEES", None]
    assert by[28].amount == -42 and by[4].amount == 6 and by[11].merchant == "m11"


def test_recurring_keys_take_no_sums_by_month(spark, ledger):
    """A key's rows are ordered once and windows count its months: the one aggregate is by account and month."""
    from kontor.operators.monthly import _recurring_spend, month_facts
    often = [(f"2026-0{m}-{d:02d}", 20.25, "Gym", "subscriptions") for m in (1, 2, 4) for d in (3, 3, 17)]
    twice = [(f"2026-0{m}-{d:02d}", 9, "Cafe", "dining") for m in (1, 2) for d in range(1, 9)]
    apart = [(f"2026-0{m}-05", a, "Shop", "shopping") for m, a in ((1, 30), (2, 30.49), (3, 30), (4, 90))]
    fixed = [(f"2026-0{m}-01", 700, "Landlord", "rent") for m in (1, 2, 3)]
    facts = month_facts(normalise_ledger(ledger(often + twice + apart + fixed)))
    found = _recurring_spend(facts.withColumn("disc", ~F.col("is_inflow") & (F.col("category") != "housing")).filter("NOT is_inflow"))
    assert found._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 2
    assert sorted((f"{r.month:%m}", r._recurring) for r in found.collect()) == [("01", 90.75), ("02", 91.24), ("03", 30.0), ("04", 60.75)]


def test_catalogue_ledger_derives_a_part_once(spark):
    from kontor.sources.fixtures import catalogue_ledger
    plan = catalogue_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "p_retailprice" in line and "decimal(12,2)" in line]
    assert plan.count("substring_index") == 1 and len(lines) == 1 and "l_orderkey" not in lines[0]
