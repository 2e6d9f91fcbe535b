"""Advice rules (L) and evaluation metrics (I, J) against hand or brute-force answers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from kontor.operators import advice as L
from kontor.operators import evaluate as J

INPUTS = ("account_id long, month date, month_text string, archetype string, archetype_description string, "
          "top_categories array<struct<category:string,amount:decimal(38,2),share:double>>, "
          "notable_changes array<struct<category:string,this_month:decimal(38,2),last_month:decimal(38,2),"
          "percent_change:double>>, "
          "flagged_count long, top_flagged struct<merchant:string,amount:decimal(38,2),date:string,"
          "reasons:array<string>>, flagged_digest decimal(38,0), "
          "total_spend decimal(38,2), recurring_spend decimal(38,2)")
M = dt.date(2026, 5, 1)


def advice(spark, rows):
    return {r.account_id: r for r in L.generate_advice(spark.createDataFrame(rows, INPUTS)).collect()}


def test_rich_and_quiet_month(spark):
    rich = (1, M, "2026-05", "Dining Led", "d",
            [("dining", Decimal("600.00"), 0.6), ("groceries", Decimal("400.00"), 0.4)],
            [("groceries", Decimal("400.00"), Decimal("300.00"), 33.3)],
            3, ("Watch", Decimal("950.00"), "2026-05-04", ["First reason"]), Decimal(17),
            Decimal("1000.00"), Decimal("200.00"))
    quiet = (2, M, "2026-05", None, None, [], [], 0, None, Decimal(0), Decimal("0.00"), Decimal("0.00"))
    got = advice(spark, [rich, quiet])
    r = got[1]
    assert r.summary == ("Your spending this month looks like a dining led pattern, led by dining at 60% of your "
                         "discretionary spending. 3 charges were flagged as unusual.")
    titles = [x.title for x in r.recommendations]
    assert titles == ["Trim dining spending", "Trim groceries spending", "Check your rising groceries costs"]
    assert r.recommendations[0].saving == 90.0
    assert r.recommendations[0].detail.endswith("Cutting it by 15% would free about $90.00 a month.")
    assert r.flagged_charge_explanation == ("The $950.00 charge at Watch on 2026-05-04 was flagged because "
                                            "first reason.")
    assert r.valid and r.has_enough_data
    q = got[2]
    assert q.source == "none" and not q.has_enough_data
    assert q.summary == ("Your spending this month looks like a typical pattern. "
                         "Nothing in your transactions looked unusual.")
    assert [x.title for x in q.recommendations] == [t for t, _ in L.FILLERS]
    assert q.flagged_charge_explanation == L.NOTHING_UNUSUAL
    assert all(x.saving >= 0 for row in got.values() for x in row.recommendations)


def test_recurring_recommendation(spark):
    row = (1, M, "2026-05", "Commuter", "d", [("transport", Decimal("100.00"), 0.1)], [], 0, None, Decimal(0),
           Decimal("1000.00"), Decimal("150.00"))
    r = advice(spark, [row])[1]
    assert r.recommendations[0].title == "Audit your recurring charges"
    assert r.recommendations[0].saving == 37.5
    assert "$150.00 of your spending is recurring subscriptions — 15% of the total." in r.recommendations[0].detail


def test_hash_changes_with_inputs(spark):
    base = (1, M, "2026-05", "A", "d", [("x", Decimal("1.00"), 1.0)], [], 0, None, Decimal(0),
            Decimal("1.00"), Decimal("0.00"))
    other = (2, M, "2026-05", "B", "d", [("x", Decimal("1.00"), 1.0)], [], 0, None, Decimal(0),
             Decimal("1.00"), Decimal("0.00"))
    same = (3,) + base[1:]
    h = {r.account_id: r.inputs_hash for r in L.inputs_hash(spark.createDataFrame([base, other, same], INPUTS)).collect()}
    assert h[1] == h[3] != h[2] and len(h[1]) == 64


# --- I / J ----------------------------------------------------------------------

def _ari(truth, pred):
    from math import comb
    from collections import Counter
    n = len(truth)
    cells = Counter(zip(truth, pred))
    a, b = Counter(truth), Counter(pred)
    idx = sum(comb(v, 2) for v in cells.values())
    sa, sb = sum(comb(v, 2) for v in a.values()), sum(comb(v, 2) for v in b.values())
    exp = sa * sb / comb(n, 2)
    mx = (sa + sb) / 2
    return 1.0 if mx == exp else (idx - exp) / (mx - exp)


def test_ari_purity_crosstab(spark):
    rng = np.random.default_rng(5)
    truth = [int(x) for x in rng.integers(0, 3, 60)]
    pred = [t if rng.random() < 0.8 else int(rng.integers(0, 4)) for t in truth]
    df = spark.createDataFrame(list(zip(truth, pred)), "truth int, cluster int")
    assert J.adjusted_rand_index(df).first().adjusted_rand_index == pytest.approx(round(_ari(truth, pred), 3))
    cells = {}
    for t, p in zip(truth, pred):
        cells[(t, p)] = cells.get((t, p), 0) + 1
    pur = sum(max(v for (t, _), v in cells.items() if t == tt) for tt in set(truth)) / len(truth)
    assert J.purity(df).first().purity == pytest.approx(round(pur, 3))
    ct = {r.truth: r for r in J.crosstab(df, [0, 1, 2, 3]).collect()}
    assert ct[0].cluster_0 == cells.get((0, 0), 0)


def _ap(truth, scores):
    order = sorted(set(scores), reverse=True)
    p_total = sum(truth)
    ap, prev_r = 0.0, 0.0
    for s in order:
        sel = [t for t, x in zip(truth, scores) if x >= s]
        tp = sum(sel)
        r = tp / p_total
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


def test_metrics_budget_and_average_precision(spark):
    rng = np.random.default_rng(9)
    scores = [float(round(x, 2)) for x in rng.random(200)]  # ties on purpose
    truth = [bool(s > 0.8 and rng.random() < 0.7) or bool(rng.random() < 0.03) for s in scores]
    rows = [(f"t{i:03d}", s, s > 0.7, t) for i, (s, t) in enumerate(zip(scores, truth))]
    df = spark.createDataFrame(rows, "transaction_id string, score double, flag boolean, truth boolean")
    m = J.metrics_at_threshold(df).first()
    tp = sum(1 for s, t in zip(scores, truth) if s > 0.7 and t)
    assert m.flagged == sum(s > 0.7 for s in scores)
    assert m.precision == pytest.approx(tp / m.flagged)
    assert m.recall == pytest.approx(tp / sum(truth))
    b = J.metrics_at_budget(df, 25).first()
    assert b.flagged == 25
    assert J.average_precision(df).first().average_precision == pytest.approx(_ap(truth, scores))


def test_split_accounts_sizes(spark):
    df = spark.createDataFrame([(i,) for i in range(47)], "account_id long")
    counts = {r.split: r["count"] for r in J.split_accounts(df).groupBy("split").count().collect()}
    assert counts == {"train": 28, "val": 9, "test": 10}


def test_top_flagged_ties_keep_higher_score(spark):
    key = "account_id long, month date"
    months = spark.createDataFrame([(1, M)], key)
    flagged = spark.createDataFrame(
        [(1, M, "Kiosk", Decimal("99.00"), M, 0.712, "a"), (1, M, "Watch", Decimal("950.00"), M, 0.80, "b"),
         (1, M, "Other", Decimal("950.00"), M, 0.75, "c")],
        key + ", merchant string, amount decimal(12,2), posted_date date, anomaly_score double, transaction_id string")
    empty = spark.createDataFrame([], key + ", rank int, category string, amount decimal(12,2), share double")
    deltas = spark.createDataFrame([], key + ", category string, this_month decimal(12,2), "
                                          "last_month decimal(12,2), percent_change double")
    arche = spark.createDataFrame([(1, M, "A", "d")], key + ", archetype string, description string")
    out = spark.createDataFrame([(1, M, Decimal("1.00"))], key + ", total_spend decimal(12,2)")
    rec = spark.createDataFrame([(1, M, 0.0)], key + ", recurring_spend double")
    row = L.advice_inputs(months, arche, empty, deltas, flagged, out, rec).first()
    assert row.flagged_count == 3
    assert row.top_flagged.merchant == "Watch"
    assert row.top_flagged.reasons == ["its anomaly score of 0.800 is well above the flagging threshold"]


def test_hash_ignores_places_that_are_not_shown(spark):
    """The digest takes scores at three places, so a change in the fifth regenerates nothing."""
    key = "account_id long, month date"
    rest = ", merchant string, amount decimal(12,2), posted_date date, anomaly_score double, transaction_id string"
    ddl = {"top": key + ", rank int, category string, amount decimal(12,2), share double",
           "deltas": key + ", category string, this_month decimal(12,2), last_month decimal(12,2), percent_change double",
           "arche": key + ", archetype string, description string", "out": key + ", total_spend decimal(12,2)", "rec": key + ", recurring_spend decimal(20,2)"}
    empty = {n: spark.createDataFrame([], d) for n, d in ddl.items()}

    def hashed(score):
        flagged = spark.createDataFrame([(1, M, "K", Decimal("9.00"), M, score, "a")], key + rest)
        i = L.advice_inputs(spark.createDataFrame([(1, M)], key), empty["arche"], empty["top"], empty["deltas"], flagged, empty["out"], empty["rec"])
        return L.inputs_hash(i).first().inputs_hash

    assert hashed(0.71234) == hashed(0.71239) != hashed(0.7131)


def test_recurring_spend_is_decimal(spark):
    """0.285 x 1.00 rounds half up to 0.29; in doubles it would be 0.28."""
    from kontor.operators.reports import recurring_spend
    raw = spark.createDataFrame([(1, M, Decimal("1.00"), "dining")], "account_id long, posted_date date, amount decimal(12,2), category string")
    f = spark.createDataFrame([(1, M, 0.285)], "account_id long, month date, recurring_share double")
    assert str(recurring_spend(raw, f).first().recurring_spend) == "0.29"


def test_budget_with_a_hot_score(spark):
    """Half of all rows share the score at which the budget runs out; rows without a score come last."""
    rows = [(f"t{i:04d}", 0.5 if i % 2 else 0.001 * i, i % 7 == 0) for i in range(400)] + [("z", None, True)]
    df = spark.createDataFrame(rows, "transaction_id string, score double, truth boolean")
    want = {t for t, s, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))[:90]}
    got = {r.transaction_id for r in J.flag_top_budget(df, 90).filter("flag").collect()}
    assert got == want
    assert J.flag_top_budget(df, 1000).filter("flag").count() == 400


def test_injection_needs_an_eligible_account(spark):
    from kontor.operators.inject import inject_anomalies
    from kontor.operators.ledger import normalise_ledger
    raw = spark.createDataFrame([("a", 1, M, Decimal("1.00"), "m", "dining", False)],
                                "transaction_id string, account_id long, posted_date date, amount decimal(12,2), merchant string, category string, pending boolean")
    with pytest.raises(ValueError):
        inject_anomalies(normalise_ledger(raw))


def test_quantiles_with_a_hot_value(spark):
    from kontor.operators.iforest import exact_quantiles
    x = [0.0] * 500 + [float(i) for i in range(1, 301)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x", [0.0, 0.3, 0.625, 0.98, 1.0])
    assert all(got[q] == pytest.approx(np.quantile(x, q)) for q in got)


def test_stored_models_are_checked(spark, tmp_path):
    from kontor.operators import contracts as C
    from kontor.plans.flows import ArchetypeModel, ForestModel
    from kontor.sources import models
    from pyspark.sql import functions as F
    names = ["a", "b"]
    stats = spark.createDataFrame([(0.0, 1.0, 2.0, 1.0)], "mean_a double, std_a double, mean_b double, std_b double")
    cents = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "cluster int, center array<double>")
    label = spark.createDataFrame([(0, "x", "d"), (1, "y", "d")], "cluster int, name string, description string")
    nodes = spark.createDataFrame([(0, 0, 1, False), (0, 1, -1, True)], "tree int, node int, feature int, leaf boolean")
    grid = spark.createDataFrame([(0.02, True)], "contamination double, chosen boolean")
    models.save_archetypes(ArchetypeModel(stats, cents, label, 2, 0.5), names, str(tmp_path / "a"))
    models.save_forest(ForestModel(nodes, 256, 0.6, 0.02, grid), ["u", "v"], str(tmp_path / "f"))
    one, two = models.load_checked(spark, str(tmp_path / "a"), str(tmp_path / "f"))
    assert (one.k, two.threshold, models.model_version_of(one, two)) == (2, 0.6, "kmeans-k2+iforest-c0.02")
    wrong = {"stats": (stats.drop("std_b"), cents, nodes), "cents": (stats, cents.withColumn("center", F.slice("center", 1, 1)), nodes),
             "nodes": (stats, cents, nodes.withColumn("feature", F.col("feature") + 1))}
    for part, (s, c, n) in wrong.items():
        with pytest.raises(C.FeatureContractError, match={"stats": "scaler", "cents": "centroids", "nodes": "forest"}[part]):
            C.require_consistent(C.artifact_consistency(s, c, names, n, ["u", "v"]))
