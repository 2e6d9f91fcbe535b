"""Standardisation, k-means archetypes, naming and evidence.

Model parameters are small tables (one stats row; k <= 8 centroid rows).
Scoring never joins them to the data: the scaler enters the plan as a scalar
subquery struct, the k centroids as literals (k x 14 numbers), so assignment
is a narrow projection over every account-month with no shuffle and no cross
join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.operators import lloyd
from kontor.operators.monthly import BEHAVIOUR_FEATURES

# Naming rules (on standardised centroids) and phrases.
NOTABLE = 0.6
RULES = [
    ("Subscription Creep", lambda f: (f["recurring_share"] > 0.8) & (f["share_subscriptions"] > 0.5)),
    ("Weekend Spender", lambda f: (f["weekend_ratio"] > 0.7) & (f["share_dining"] > 0.2)),
    ("Big-Ticket Buyer", lambda f: (f["avg_ticket"] > 0.8) & (f["txn_count"] < -0.3)),
    ("Frequent Small Spender", lambda f: (f["txn_count"] > 0.8) & (f["avg_ticket"] < -0.4)),
    ("Essentials Focused", lambda f: (f["share_groceries"] > 0.5) & (f["weekend_ratio"] < 0.1)),
    ("Retail Heavy", lambda f: f["share_shopping"] > 0.7),
    ("Dining Led", lambda f: f["share_dining"] > 0.6),
    ("Commuter", lambda f: f["share_transport"] > 0.7),
    ("High Fixed Costs", lambda f: f["fixed_share"] > 0.8),
]
PHRASES = {
    "txn_count": ("makes many small purchases", "transacts rarely"),
    "avg_ticket": ("has large typical purchases", "has small typical purchases"),
    "ticket_variability": ("purchase sizes vary a lot", "purchase sizes are consistent"),
    "merchant_diversity": ("shops at many different merchants", "sticks to a few merchants"),
    "weekend_ratio": ("spends mostly on weekends", "spends mostly on weekdays"),
    "recurring_share": ("carries a lot of subscriptions", "has few subscriptions"),
    "fixed_share": ("has high fixed costs", "has low fixed costs"),
    "spend_to_income": ("spends most of their income", "saves a large share of income"),
    "share_dining": ("eats out often", "rarely eats out"),
    "share_groceries": ("spends heavily on groceries", "spends little on groceries"),
    "share_subscriptions": ("is subscription-heavy", "has minimal subscriptions"),
    "share_transport": ("spends heavily on transport", "spends little on transport"),
    "share_shopping": ("shops a lot", "shops rarely"),
    "share_entertainment": ("spends on entertainment", "spends little on entertainment"),
}
CLOSE_TO_AVERAGE = "Close to average on every behaviour I measure."
BALANCED = "Balanced Spender"
K_RANGE = range(2, 9)
SEED = 42
RESTARTS = 10


# --- H2 / H9 -----------------------------------------------------------------

def fit_scaler(features: DataFrame, names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """Population mean and std per feature (scikit-learn StandardScaler), one row."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"mean_{n}"), F.stddev_pop(n).alias(f"std_{n}")]
    return features.agg(*aggs)


def _stats_struct(stats: DataFrame) -> Column:
    """The one-row stats table as a scalar-subquery struct (reused by Spark)."""
    return stats.select(F.struct(*stats.columns)).scalar()


def standardise(features: DataFrame, stats: DataFrame,
                names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H2: z_<name> = (x - mean) / std, zero-variance columns scaled by 1."""
    s = _stats_struct(stats)
    zs = []
    for n in names:
        std = s[f"std_{n}"]
        zs.append(((F.col(n) - s[f"mean_{n}"]) / F.when(std > 0, std).otherwise(F.lit(1.0))).alias(f"z_{n}"))
    return features.select("*", *zs)


def centroid_real_units(centroids: DataFrame, stats: DataFrame,
                        names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H9: inverse transform of standardised centroids, rounded to 3."""
    s = _stats_struct(stats)
    cols = []
    for i, n in enumerate(names):
        std = s[f"std_{n}"]
        scale = F.when(std > 0, std).otherwise(F.lit(1.0))
        cols.append(F.round(F.col("center")[i] * scale + s[f"mean_{n}"], 3).alias(n))
    return centroids.select("cluster", *cols)


# --- H4 ----------------------------------------------------------------------

def _zvec(names: list[str]) -> Column:
    return F.array(*[F.col(f"z_{n}") for n in names])


def centroid_rows(centroids: DataFrame) -> list[tuple[int, list[float]]]:
    """The k centroid rows of a model table, read once on the driver.

    Model parameters are k x 14 numbers; they become literals in the scoring
    projection (codegen constants), so no join and no broadcast of data happens.
    """
    rows = centroids.orderBy("cluster").collect()
    return [(int(r["cluster"]), [float(x) for x in r["center"]]) for r in rows]


def assign_cluster(z: DataFrame, centroids: DataFrame, model_version: str | None = None,
                   names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H4: nearest centroid (ties -> lowest id) and Euclidean distance (3 dp).

    The k centroids are one literal array; the z vector is built once per row
    and every distance is a fold over it, so the generated code stays small
    whatever k is.
    """
    cents = F.array(*[F.struct(F.lit(cid).alias("cluster"),
                               F.array(*[F.lit(float(c)) for c in center]).alias("center"))
                      for cid, center in centroid_rows(centroids)])
    v = _zvec(names)
    dists = F.transform(cents, lambda c: F.struct(
        F.sqrt(F.aggregate(F.zip_with(c["center"], v, lambda a, b: (b - a) * (b - a)),
                           F.lit(0.0), lambda acc, x: acc + x)).alias("d"),
        c["cluster"].alias("cluster")))
    out = z.withColumn("_best", F.array_min(dists)).select(
        "*", F.col("_best.cluster").alias("cluster"),
        F.round(F.col("_best.d"), 3).alias("distance_to_centroid")).drop("_best")
    if model_version is not None:
        out = out.withColumn("model_version", F.lit(model_version))
    return out


# --- H10 / H11 ---------------------------------------------------------------

def month_evidence(z: DataFrame, stats: DataFrame, limit: int = 3,
                   names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """Per month the `limit` features with the largest |z| (ties keep
    feature order): value (3 dp), population mean (3 dp), z (2 dp).

    The population means are a one-row model table read as literals.
    """
    st = stats.first()
    items = F.array(*[F.struct(F.abs(F.col(f"z_{n}")).alias("k"), F.lit(-i).alias("o"),
                               F.lit(n).alias("feature"),
                               F.round(F.col(n), 3).alias("your_value"),
                               F.round(F.lit(st[f"mean_{n}"]), 3).alias("population_average"),
                               F.round(F.col(f"z_{n}"), 2).alias("std_devs_from_average"))
                      for i, n in enumerate(names)])
    top = F.slice(F.sort_array(items, asc=False), 1, limit)
    ev = F.transform(top, lambda e: F.struct(e["feature"].alias("feature"),
                                             e["your_value"].alias("your_value"),
                                             e["population_average"].alias("population_average"),
                                             e["std_devs_from_average"].alias("std_devs_from_average")))
    return z.select("account_id", "month", ev.alias("evidence"))


def cluster_shares(assigned: DataFrame) -> DataFrame:
    """Fraction of months per cluster."""
    total = assigned.agg(F.count(F.lit(1))).scalar()
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("months")) \
        .withColumn("share", F.col("months") / total)


# --- H8 / H7 -----------------------------------------------------------------

def _centroid_items(names: list[str]) -> Column:
    return F.array(*[F.struct(F.abs(F.col("center")[i]).alias("k"), F.lit(-i).alias("o"),
                              F.lit(n).alias("feature"), F.col("center")[i].alias("v"),
                              F.lit(PHRASES[n][0]).alias("high"), F.lit(PHRASES[n][1]).alias("low"))
                     for i, n in enumerate(names)])


def describe_centroid(centroids: DataFrame, limit: int = 3,
                      names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H8: top features with |z| >= 0.6 -> sentence and evidence."""
    ranked = F.sort_array(_centroid_items(names), asc=False)
    notable = F.slice(F.filter(ranked, lambda e: e["k"] >= NOTABLE), 1, limit)
    phrases = F.transform(notable, lambda e: F.when(e["v"] > 0, e["high"]).otherwise(e["low"]))
    description = F.when(F.size(notable) == 0, F.lit(CLOSE_TO_AVERAGE)).otherwise(
        F.concat(F.lit("This group "), F.array_join(phrases, ", "), F.lit(".")))
    evidence = F.transform(notable, lambda e: F.struct(e["feature"].alias("feature"),
                                                       F.round(e["v"], 2).alias("std_devs_from_average")))
    return centroids.select("cluster", description.alias("description"), evidence.alias("evidence"))


def _fallback_name(names: list[str]) -> Column:
    top = F.array_max(_centroid_items(names))  # largest |z|, first feature on ties
    pretty = F.initcap(F.regexp_replace(F.regexp_replace(top["feature"], "share_", ""), "_", " "))
    return F.when(top["k"] < NOTABLE, F.lit(BALANCED)).otherwise(
        F.concat(F.when(top["v"] > 0, F.lit("High ")).otherwise(F.lit("Low ")), pretty))


def name_clusters(centroids: DataFrame, names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H7: rule matrix per centroid as columns; the greedy 'first unused rule
    wins in cluster order' claim runs over the k (<= 8) rule rows."""
    f = {n: F.col("center")[i] for i, n in enumerate(names)}
    matches = F.array(*[F.when(rule(f), F.lit(label)) for label, rule in RULES])
    table = centroids.select("cluster", F.array_compact(matches).alias("candidates"),
                             _fallback_name(names).alias("fallback"))
    used: set[str] = set()
    out = []
    for row in table.orderBy("cluster").collect():  # k <= 8 model rows
        label = next((c for c in row["candidates"] if c not in used), None) or row["fallback"]
        used.add(label)
        out.append((int(row["cluster"]), label))
    named = centroids.sparkSession.createDataFrame(out, "cluster int, name string")
    return named.join(describe_centroid(centroids, names=names), "cluster")


# --- H3 / H5 / H6 ------------------------------------------------------------

def _vectors(z: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return z.select("*", array_to_vector(_zvec(names)).alias("zvec"))


def _points(z: DataFrame, names: list[str]) -> DataFrame:
    return lloyd.vector_table(z, _zvec(names).cast("array<double>"))


def _centroids(spark, fit: lloyd.Fit) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fit.centers)], "cluster int, center array<double>")


def kmeans_fit(z: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED,
               names: list[str] = BEHAVIOUR_FEATURES):
    """H3: `restarts` seeded k-means runs in one batch (every restart takes part in each pass over
    the rows); the lowest inertia is kept. (centroids DataFrame, inertia, the fit)"""
    best = lloyd.best_of(lloyd.fit_all(_points(z, names), [k], restarts, seed), k)
    return _centroids(z.sparkSession, best), best.inertia, best


def silhouette(assigned: DataFrame, names: list[str] = BEHAVIOUR_FEATURES) -> float:
    """H6 at scale: Spark's ClusteringEvaluator. Its silhouette uses squared
    Euclidean distance (decomposable into per-cluster sums), so it is reported
    as the squared-distance silhouette, not the Euclidean one."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    data = _vectors(assigned, names).select("zvec", F.col("cluster").cast("int").alias("cluster"))
    ev = ClusteringEvaluator(featuresCol="zvec", predictionCol="cluster",
                             distanceMeasure="squaredEuclidean", metricName="silhouette")
    return float(ev.evaluate(data))


def euclidean_silhouette(assigned: DataFrame, names: list[str] = BEHAVIOUR_FEATURES, sample: int = lloyd.SAMPLE) -> tuple[float, float, int]:
    """H6 by Euclidean distances: (value, standard error, rows sampled); exact where the table has at most `sample` rows."""
    return lloyd.euclidean_silhouette(lloyd.vector_table(assigned, _zvec(names).cast("array<double>"), "cluster"), sample)


def fit_best_k(z: DataFrame, k_range=K_RANGE, restarts: int = RESTARTS, names: list[str] = BEHAVIOUR_FEATURES):
    """H5: all k and restarts in one batch; (rows of k, inertia, silhouette; the best k, first on ties; its centroids)."""
    points, ks = _points(z, names), list(k_range)
    fits = lloyd.fit_all(points, ks, restarts, SEED)
    best = {k: lloyd.best_of(fits, k) for k in ks}
    scores = lloyd.squared_silhouettes(points, [best[k] for k in ks])
    rows = [(k, best[k].inertia, s) for k, s in zip(ks, scores, strict=True)]
    chosen = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return rows, chosen, _centroids(z.sparkSession, best[chosen])


def choose_k(z: DataFrame, k_range=K_RANGE, restarts: int = RESTARTS,
             names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """H5: inertia and silhouette per k; `chosen` marks the max silhouette (first on ties)."""
    rows, best, _ = fit_best_k(z, k_range, restarts, names)
    return z.sparkSession.createDataFrame(
        [(k, c, s, k == best) for k, c, s in rows],
        "k int, inertia double, silhouette_squared_euclidean double, chosen boolean")


def fixed_centroids(spark, k: int = 6, names: list[str] = BEHAVIOUR_FEATURES) -> DataFrame:
    """A rule-made centroid table for tests and oracle checks: centroid c has
    +1.0 at feature (5c mod n) and -1.0 at feature (5c + 7 mod n)."""
    n = len(names)
    rows = []
    for c in range(k):
        v = [0.0] * n
        v[(5 * c) % n] = 1.0
        v[(5 * c + 7) % n] = -1.0
        rows.append((c, v))
    return spark.createDataFrame(rows, "cluster int, center array<double>")
