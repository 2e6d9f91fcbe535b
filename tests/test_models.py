"""Scaler, cluster assignment and naming, silhouette, forest, reasons, contracts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.operators import clusters as H
from kontor.operators import iforest as IF
from kontor.operators import lloyd
from kontor.operators.causal import ANOMALY_FEATURES
from kontor.operators.contracts import FeatureContractError, assert_finite, feature_contract
from kontor.operators.explain import explain_flags

NAMES = ["a", "b"]


def test_standardise_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "account_id long, a double, b double")
    stats = H.fit_scaler(df, NAMES)
    z = {r.account_id: r for r in H.standardise(df, stats, NAMES).collect()}
    assert z[1].z_a == pytest.approx(-1.0)  # population std = 1
    assert z[1].z_b == 0.0                  # zero variance scaled by 1


def test_assign_cluster_ties_to_lowest_id(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0)], "account_id long, z_a double, z_b double")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [3.0, 0.0])],
                                  "cluster int, center array<double>")
    got = {r.account_id: r for r in H.assign_cluster(z, cents, "v", NAMES).collect()}
    assert got[1].cluster == 0 and got[1].distance_to_centroid == pytest.approx(1.0)
    assert got[2].cluster == 0  # equidistant to 0 and 2: the lowest id wins


def test_name_clusters_greedy_and_fallback(spark):
    names = H.BEHAVIOUR_FEATURES
    v0 = [0.0] * len(names)
    v0[names.index("share_dining")] = 0.9
    v1 = list(v0)  # same rule again: already used, falls back
    v2 = [0.1] * len(names)
    cents = spark.createDataFrame([(0, v0), (1, v1), (2, v2)], "cluster int, center array<double>")
    got = {r.cluster: r for r in H.name_clusters(cents).collect()}
    assert got[0].name == "Dining Led"
    assert got[1].name == "High Dining"
    assert got[2].name == "Balanced Spender"
    assert got[2].description == H.CLOSE_TO_AVERAGE
    assert got[0].description == "This group eats out often."


def _brute_silhouette_sq(x, labels):
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(n):
        own = labels == labels[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (15, 2)), rng.normal(6, 1, (15, 2))])
    labels = np.array([0] * 15 + [1] * 15)
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "account_id long, z_a double, z_b double, cluster int")
    assert H.silhouette(df, NAMES) == pytest.approx(_brute_silhouette_sq(x, labels), abs=1e-6)


def test_kmeans_recovers_two_groups(spark):
    rows = [(i, float(i % 5) * 0.01, 0.0) for i in range(20)] + [(100 + i, 5.0 + (i % 3) * 0.01, 5.0) for i in range(20)]
    z = spark.createDataFrame(rows, "account_id long, z_a double, z_b double")
    cents, cost, _ = H.kmeans_fit(z, 2, restarts=3, names=NAMES)
    assigned = H.assign_cluster(z, cents, names=NAMES).collect()
    groups = {r.account_id < 100: r.cluster for r in assigned}
    assert len(set(groups.values())) == 2
    assert cost < 1.0


def test_batched_kmeans_equals_single_fits(spark, monkeypatch):
    """Every model of a batch ends where plain Lloyd steps from its seeds end, and all take part in the same passes."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 1.0, (40, 3)) for c in (0, 4, 9)])
    x = np.vstack([x, x[:5]])
    z = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "account_id long, z_a double, z_b double, z_c double")
    names, passes = ["a", "b", "c"], []
    real = lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda data, fits: passes.append(len(fits)) or real(data, fits))
    points = H._points(z, names)
    start = lloyd.seeds(points, 3, 4, 7)
    fits = lloyd.fit_all(points, [2, 3, 4], 3, 7)
    assert passes[0] == 9 and len(passes) == max(f.passes for f in fits)
    for f in fits:
        c = start[f.restart][:f.k].copy()
        assert all((x == v).all(1).any() for v in c) and len(np.unique(c, axis=0)) == f.k
        for _ in range(300):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(f.k)])
            if np.sqrt(((new - c) ** 2).sum(1).max()) <= lloyd.TOLERANCE:
                break
            c = new
        assert f.centers == pytest.approx(c) and f.inertia == pytest.approx(((x[:, None] - c) ** 2).sum(2).min(1).sum())
    rows, best, cents = H.fit_best_k(z, (2, 3, 4), 3, names)
    assert best == 3 and cents.count() == 3
    for k, _, s in rows:
        fit = lloyd.best_of(lloyd.fit_all(points, [k], 3, H.SEED), k)
        labels = ((x[:, None] - fit.centers) ** 2).sum(2).argmin(1)
        assert s == pytest.approx(_brute_silhouette_sq(x, labels), abs=1e-9)


def test_kmeans_edges(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(6)], "account_id long, z_a double, z_b double")
    cents, cost, _ = H.kmeans_fit(same, 3, restarts=2, names=NAMES)
    assert cost == 0 and cents.count() == 3
    with pytest.raises(ValueError, match="no rows"):
        H.kmeans_fit(same.limit(0), 2, restarts=2, names=NAMES)


def test_euclidean_silhouette(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(4, 1, (60, 2)), rng.normal(8, 1, (1, 2))])
    labels = np.array([0] * 150 + [1] * 60 + [5])
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "account_id long, z_a double, z_b double, cluster int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    s = []
    for i, c in enumerate(labels):
        own = (labels == c) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean() if own.any() else None, min(d[i, labels == o].mean() for o in set(labels) - {c})
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert H.euclidean_silhouette(df, NAMES) == (pytest.approx(np.mean(s)), 0.0, len(x))
    value, error, n = H.euclidean_silhouette(df, NAMES, sample=80)
    assert 60 <= n <= 90 and 0 < error < 0.05 and abs(value - np.mean(s)) < 4 * error


def _txn_frame(spark, n=400, outliers=5):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        v = rng.normal(10, 1, len(ANOMALY_FEATURES))
        if i < outliers:
            v = v + 25
        rows.append((f"t{i:04d}", 1, *[float(x) for x in v]))
    cols = "transaction_id string, account_id long, " + ", ".join(f"{c} double" for c in ANOMALY_FEATURES)
    return spark.createDataFrame(rows, cols)


def test_forest_scores_outliers_higher_and_is_deterministic(spark):
    df = _txn_frame(spark)
    nodes, psi = IF.iforest_fit(df, ANOMALY_FEATURES, trees=50)
    assert psi == 256
    s1 = {r.transaction_id: r.anomaly_score for r in IF.iforest_score(df, nodes, psi, ANOMALY_FEATURES).collect()}
    nodes2, _ = IF.iforest_fit(df.repartition(7), ANOMALY_FEATURES, trees=50)
    s2 = {r.transaction_id: r.anomaly_score for r in IF.iforest_score(df, nodes2, psi, ANOMALY_FEATURES).collect()}
    assert s1 == pytest.approx(s2)  # same trees under another partitioning
    outlier = min(s1[f"t{i:04d}"] for i in range(5))
    normal = sorted(s1[f"t{i:04d}"] for i in range(5, 400))
    assert outlier > normal[int(0.95 * len(normal))]
    assert nodes.agg(F.max("depth")).first()[0] <= 8


def test_contamination_threshold_is_numpy_percentile(spark):
    vals = [float(v) for v in np.random.default_rng(1).random(101)]
    df = spark.createDataFrame([(v,) for v in vals], "anomaly_score double")
    assert IF.contamination_threshold(df, 0.02) == pytest.approx(float(np.percentile(vals, 98)))


def test_model_version():
    assert IF.model_version(6, 0.02) == "kmeans-k6+iforest-c0.02"


def test_feature_contract_rejects_missing_and_unknown(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, zzz double")
    with pytest.raises(FeatureContractError, match="absent=.*b.*foreign=.*zzz"):
        feature_contract(df, ["a", "b"])
    ok = spark.createDataFrame([(2.0, 1.0)], "b double, a double")
    assert feature_contract(ok, ["a", "b"]).columns == ["a", "b"]


def test_non_finite_fails_whole_batch(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "a double")
    with pytest.raises(Exception):
        assert_finite(df, ["a"]).collect()


def test_explain_flags(spark):
    cols = ["amount_zscore_in_category", "amount_ratio_to_category_median", "merchant_novelty",
            "merchant_txns_same_day", "category_rarity"]
    df = spark.createDataFrame([(True, 4.25, 3.35, 1.0, 4.0, 0.99), (True, 0.0, 1.0, 0.0, 1.0, 0.0),
                                (False, 9.0, 9.0, 1.0, 9.0, 1.0)],
                               "is_anomaly boolean, " + ", ".join(f"{c} double" for c in cols))
    r = [x.reasons for x in explain_flags(df).collect()]
    assert r[0] == ["Amount is 4.2 standard deviations above your usual for this category",
                    "About 3.4x your typical spend in this category",
                    "First time you've used this merchant",
                    "4 charges at this merchant on the same day — a pattern that can indicate card testing",
                    "This spending category is unusual for this account"]
    assert r[1] == ["Unusual combination of amount, timing and merchant history"]
    assert r[2] == []


def test_forest_walk_equals_recursion_over_the_nodes():
    """Trees of any shape, values at thresholds and NaN (which go right) give the paths of a plain walk."""
    import numpy as np
    import pandas as pd
    from kontor.operators import iforest as IF
    x = np.round(np.random.default_rng(3).gamma(1, 5, (IF.CACHED_ROWS + 50, 4)))
    x[::11, 1] = np.nan
    rows = [r for t in range(6) for r in IF._build_tree(t, np.nan_to_num(x[t * 40:t * 40 + (1 if t == 5 else 32)]), 5, 9)]
    pdf = pd.DataFrame(rows, columns=IF.NODE_SCHEMA.fieldNames())
    nodes = {(r.tree, r.node): r for r in pdf.itertuples()}

    def path(tree, v, n=0):
        r = nodes[tree, n]
        return r.depth + float(IF.average_path_length([r.size])[0]) if r.leaf else path(tree, v, r.left if v[r.feature] <= r.threshold else r.right)

    forest = IF.ForestArrays(pdf, 32)
    at = [*range(60), *range(IF.CACHED_ROWS - 5, IF.CACHED_ROWS + 50)]
    want = [2 ** (-np.mean([path(t, x[i]) for t in range(6)]) / forest.norm) for i in at]
    assert np.allclose(forest.score(x)[at], want, rtol=1e-12, atol=0)
    assert not hasattr(forest, "left")  # children by place: one comparison a step, no look-ups of nodes


def test_fit_reads_its_ledger_once(spark):
    import datetime as dt
    from decimal import Decimal
    from kontor.operators.ledger import normalise_ledger
    from kontor.plans import flows
    rows = [(f"t{a}-{i}", a, dt.date(2026, 1, 1) + dt.timedelta(days=i % 28), Decimal(5 + (i * a) % 40), f"m{i % 5}", "dining", False)
            for a in range(10) for i in range(45)]
    raw = spark.createDataFrame(rows, "transaction_id string, account_id long, posted_date date, amount decimal(12,2), merchant string, category string, pending boolean")
    seen = spark.sparkContext.accumulator(0)

    def touch(merchant: str) -> str:
        seen.add(1)
        return merchant

    from pyspark.sql import functions as F
    model = flows.fit_forest(normalise_ledger(raw.withColumn("merchant", F.udf(touch, "string")("merchant"))))
    assert model.psi > 0 and seen.value == len(rows)


def test_scan_computes_and_scores_a_row_once(spark, monkeypatch):
    import datetime as dt
    from decimal import Decimal
    from kontor.operators import causal
    from kontor.operators import iforest as IF
    from kontor.operators.ledger import normalise_ledger
    from kontor.plans import flows
    rows = [(f"t{a}-{i}", a, dt.date(2026, 1, 1) + dt.timedelta(days=i % 28), Decimal(5 + (i * a) % 41), f"m{i % 5}", ("dining", "travel")[i % 2], False)
            for a in range(150) for i in range(42)]
    raw = spark.createDataFrame(rows, "transaction_id string, account_id long, posted_date date, amount decimal(12,2), merchant string, category string, pending boolean")
    led = flows.scorable(normalise_ledger(raw))
    splits = flows.split_of(led)
    apart = flows.fit_forest(led, splits)
    want = sorted(map(tuple, flows.anomaly_scan(led, apart, "v").collect()))
    computed, walked = [], []
    features, score = causal.transaction_features, IF.iforest_score

    def counted(ledger, *args, **kwargs):
        computed.append(ledger.count())
        return features(ledger, *args, **kwargs)

    def scored_rows(of, *args, **kwargs):
        walked.append(of.count())
        return score(of, *args, **kwargs)

    monkeypatch.setattr(causal, "transaction_features", counted)
    monkeypatch.setattr(flows, "transaction_features", counted)
    monkeypatch.setattr(IF, "iforest_score", scored_rows)
    model, scored = flows.fit_and_score(led, splits)
    assert (model.threshold, model.contamination) == (apart.threshold, apart.contamination)
    assert sorted(map(tuple, model.grid.collect())) == sorted(map(tuple, apart.grid.collect()))
    assert sorted(map(tuple, flows.anomaly_scan(led, model, "v", scored).collect())) == want and len(want) == len(rows)
    # every row once, and again the validation accounts that got injected rows, with these (8 + 8 + 8 * 4)
    val = 42 * splits.filter("split = 'val'").count()
    assert computed == [len(rows), walked[1]] and walked[0] == len(rows)
    assert 48 < walked[1] < val + 48


def test_rows_to_inject_into_are_read_once(spark):
    """Splits read the ledger once; injection into a scored ledger reads it for the accounts' counts and for the rows of those drawn."""
    import datetime as dt
    from decimal import Decimal
    from pyspark.sql import functions as F
    from kontor.operators import evaluate as J
    from kontor.operators.inject import prepare_eval_set
    from kontor.operators.ledger import normalise_ledger
    from kontor.plans import flows
    rows = [(f"t{a}-{i}", a, dt.date(2026, 1, 1) + dt.timedelta(days=i % 28), Decimal(5 + (i * a) % 41), f"m{i % 5}", ("dining", "travel")[i % 2], False)
            for a in range(60) for i in range(42)]
    raw = spark.createDataFrame(rows, "transaction_id string, account_id long, posted_date date, amount decimal(12,2), merchant string, category string, pending boolean")
    led = flows.scorable(normalise_ledger(raw))
    seen = spark.sparkContext.accumulator(0)

    def touch(value):
        seen.add(1)
        return value

    splits = flows.cut_lineage(J.split_accounts(led.withColumn("account_id", F.udf(touch, "long")("account_id"))))
    assert seen.value == len(rows) and splits.count() == 60
    features = flows.scan_features(led)
    seen.value = 0
    touched = led.withColumn("amount", F.udf(touch, "decimal(12,2)").asNondeterministic()("amount"))  # once for filter and column
    marked = ["transaction_id", "account_id", *ANOMALY_FEATURES, "is_injected_anomaly", "anomaly_kind"]
    got = sorted(map(tuple, prepare_eval_set(touched, splits, "val", inject=True, known=features).select(marked).collect()), key=repr)
    assert seen.value <= 2 * len(rows)
    want = sorted(map(tuple, prepare_eval_set(led, splits, "val", inject=True).select(marked).collect()), key=repr)
    assert got == want and sum(r[-2] for r in got) == 48
