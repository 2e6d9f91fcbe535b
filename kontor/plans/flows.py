"""End-to-end plans (the reference's three entry points, for all accounts at once).

1. archetypes: ledger -> A2 -> E1 -> F -> scaler -> k-means -> names ->
   assignment + evidence for every account-month.
2. anomaly scan: ledger -> B5/G -> forest score -> threshold -> reasons.
3. offline evaluation: split accounts -> fit forest on clean train accounts ->
   tune contamination on injected validation accounts -> compare the forest
   with the z-score baseline on injected test accounts.

Intermediate results that several jobs reuse are cut with a reliable
checkpoint into the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators import clusters as H
from kontor.operators import evaluate as J
from kontor.operators import iforest as IF
from kontor.operators.causal import ANOMALY_FEATURES, spend_only, transaction_features
from kontor.operators.inject import prepare_eval_set
from kontor.operators.ledger import normalise_ledger
from kontor.operators.monthly import BEHAVIOUR_FEATURES, monthly_features
from kontor.operators.recurring import AS_OF_MONTHS
from kontor.session import cut_lineage


@dataclass
class ArchetypeModel:
    stats: DataFrame
    centroids: DataFrame
    names: DataFrame
    k: int
    silhouette: float


def fit_archetypes(features: DataFrame, k: int | None = None, restarts: int = H.RESTARTS) -> ArchetypeModel:
    """Fit scaler + k-means (choose k by silhouette when k is None) + names."""
    stats = cut_lineage(H.fit_scaler(features))
    z = cut_lineage(H.standardise(features, stats))
    if k is None:
        rows, k, cents = H.fit_best_k(z, restarts=restarts)
        sil = next(s for of, _, s in rows if of == k)
    else:
        cents, _, _ = H.kmeans_fit(z, k, restarts)
        sil = H.silhouette(H.assign_cluster(z, cents))
    cents = cut_lineage(cents)
    return ArchetypeModel(stats, cents, H.name_clusters(cents), k, sil)


def features_as_of(raw: DataFrame) -> DataFrame:
    """F of every account-month M from the ledger of M-11..M alone: what a request for M sees, so
    later months never change it."""
    return monthly_features(normalise_ledger(raw), as_of=AS_OF_MONTHS)


def archetypes(raw: DataFrame, model: ArchetypeModel | None = None, contamination: float | None = None) -> DataFrame:
    """Entry 1 for every account-month: cluster, archetype, distance, evidence.

    Without a stored model one is fitted, with k chosen by silhouette; `contamination` is
    that of the forest deployed with it, if any, for the version stamp.
    """
    features = cut_lineage(features_as_of(raw))
    model = model or fit_archetypes(features)
    z = H.standardise(features, model.stats)
    assigned = H.assign_cluster(z, model.centroids, IF.model_version(model.k, contamination))
    evidence = H.month_evidence(z, model.stats)
    names = model.names.select("cluster", F.col("name").alias("archetype"), "description")
    # names has k rows: a bounded model table joined by the planner's broadcast threshold
    return (assigned.join(F.broadcast(names), "cluster")
            .join(evidence, ["account_id", "month"])
            .select("account_id", "month", "cluster", "archetype", "description",
                    "distance_to_centroid", "evidence", "model_version", *BEHAVIOUR_FEATURES))


@dataclass
class ForestModel:
    nodes: DataFrame
    psi: int
    threshold: float
    contamination: float
    grid: DataFrame


def scorable(ledger: DataFrame) -> DataFrame:
    """The spend rows that splits, fits and scans read, written once: each of them reads them several times."""
    return cut_lineage(spend_only(ledger))


def split_of(ledger: DataFrame) -> DataFrame:
    """Accounts dealt to train, validation and test."""
    return cut_lineage(J.split_accounts(spend_only(ledger), seed=42))


def scan_features(ledger: DataFrame) -> DataFrame:
    """What fits and scans read of a spend row, written once: a row's features follow from its own account, so they are the
    same in a split and in the whole ledger."""
    return cut_lineage(transaction_features(ledger, labels=()).select("transaction_id", "account_id", *ANOMALY_FEATURES))


def fit_forest(ledger: DataFrame, splits: DataFrame | None = None) -> ForestModel:
    """Fit on the clean spend rows of the train accounts; the contamination with the best F1 on injected
    validation accounts sets the threshold (H12, H15). Without splits the ledger is written first (see `scorable`)."""
    if splits is None:
        ledger = scorable(ledger)
        splits = split_of(ledger)
    train = cut_lineage(prepare_eval_set(ledger, splits, "train", inject=False).select("transaction_id", *ANOMALY_FEATURES))
    nodes, psi = IF.iforest_fit(train, ANOMALY_FEATURES)
    nodes = cut_lineage(nodes)
    val = prepare_eval_set(ledger, splits, "val", inject=True, seed=7)
    return _tuned(IF.iforest_score(train, nodes, psi, ANOMALY_FEATURES), IF.iforest_score(val, nodes, psi, ANOMALY_FEATURES), nodes, psi)


def _tuned(train_scored: DataFrame, val_scored: DataFrame, nodes: DataFrame, psi: int) -> ForestModel:
    """The contamination with the best F1 on the validation rows (H15) and its threshold."""
    val_scored = cut_lineage(val_scored.select("anomaly_score", F.col("is_injected_anomaly").alias("truth")))
    grid = cut_lineage(IF.tune_contamination(train_scored.select("anomaly_score"), val_scored))
    chosen = grid.filter("chosen").first()
    return ForestModel(nodes, psi, float(chosen["threshold"]), float(chosen["contamination"]), grid)


def fit_and_score(ledger: DataFrame, splits: DataFrame) -> tuple[ForestModel, DataFrame]:
    """`fit_forest` of a written ledger whose rows are all scored as well: the model, and the features of every spend row with
    its score. Features are computed and trees walked once for a row; train and validation rows are taken from these, and
    only accounts that get injected rows are computed again."""
    features = scan_features(ledger)
    nodes, psi = IF.iforest_fit(prepare_eval_set(ledger, splits, "train", inject=False, known=features), ANOMALY_FEATURES)
    nodes = cut_lineage(nodes)
    scored = cut_lineage(IF.iforest_score(features, nodes, psi, ANOMALY_FEATURES))
    val = prepare_eval_set(ledger, splits, "val", inject=True, seed=7, known=scored)
    anew = IF.iforest_score(val.filter("anomaly_score IS NULL").drop("anomaly_score"), nodes, psi, ANOMALY_FEATURES)
    train = prepare_eval_set(ledger, splits, "train", inject=False, known=scored)
    return _tuned(train, val.filter("anomaly_score IS NOT NULL").unionByName(anew), nodes, psi), scored


def anomaly_evaluation(ledger: DataFrame, with_scored: bool = False):
    """Entry 3: metrics of forest vs z-score on injected held-out accounts.

    Returns one row per detector with threshold, budget and threshold-free
    metrics; with `with_scored`, also the scored test rows (for J7 by kind).
    """
    ledger = scorable(ledger)
    splits = split_of(ledger)
    model = fit_forest(ledger, splits)
    nodes, psi, threshold, c = model.nodes, model.psi, model.threshold, model.contamination
    test = prepare_eval_set(ledger, splits, "test", inject=True, seed=99)
    scored = cut_lineage(
        IF.iforest_score(test, nodes, psi, ANOMALY_FEATURES)
        .select("transaction_id", "account_id", F.col("anomaly_score").alias("forest_score"),
                F.col("amount_zscore_in_category").alias("zscore_score"),
                (F.col("anomaly_score") > threshold).alias("forest_flag"),
                (F.col("amount_zscore_in_category") > 3.0).alias("zscore_flag"),
                F.col("is_injected_anomaly").alias("truth"), F.col("anomaly_kind").alias("kind")))
    budget = scored.filter("forest_flag").count()
    rows = None
    for det in ("forest", "zscore"):
        s = scored.select("transaction_id", F.col(f"{det}_score").alias("score"),
                          F.col(f"{det}_flag").alias("flag"), "truth")
        m = J.metrics_at_threshold(s).select(
            F.lit(det).alias("detector"), "flagged", "precision", "recall", "f1",
            "false_positives", "missed")
        b = J.metrics_at_budget(s, max(budget, 1)).select(
            F.col("precision").alias("budget_precision"), F.col("recall").alias("budget_recall"),
            F.col("f1").alias("budget_f1"))
        ap = J.average_precision(s).scalar()
        row = m.select("*", b.select(F.struct(*b.columns)).scalar().alias("b"),
                       ap.alias("average_precision")).select("*", "b.*").drop("b")
        rows = row if rows is None else rows.unionByName(row)
    compared = J.compare_detectors(rows).withColumn("contamination", F.lit(c)) \
        .withColumn("budget", F.lit(budget)) \
        .withColumn("model_version", F.lit(f"iforest-c{c}"))
    return (compared, scored) if with_scored else compared


def recall_by_kind_eval(scored: DataFrame) -> DataFrame:
    return J.recall_by_kind(scored, ["forest_flag", "zscore_flag"])


def anomaly_scan(ledger: DataFrame, model: ForestModel, version: str, scored: DataFrame | None = None) -> DataFrame:
    """Entry 2 for every scorable transaction: score, flag, reasons; `scored`: its features with this model's score, if written."""
    feats = transaction_features(ledger) if scored is None else scored
    return IF.score_transactions(feats, model.nodes, model.psi, model.threshold, version,
                                 ANOMALY_FEATURES)
