"""Registered queries for H2-H11 (archetypes) and I (cluster validation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import clusters as H
from kontor.operators import evaluate as J
from kontor.operators.monthly import BEHAVIOUR_FEATURES as NAMES
from kontor.plans.q_features import FEAT_CAT, features_catalogue
from kontor.plans.registry import d10, flat, query, r6
from kontor.session import cut_lineage
from kontor.sources.tables import table

K_FIXED = 6


def _fixed(spark):
    return H.fixed_centroids(spark, K_FIXED)


def _fixed_values():
    n = len(NAMES)
    out = []
    for c in range(K_FIXED):
        v = [0.0] * n
        v[(5 * c) % n] = 1.0
        v[(5 * c + 7) % n] = -1.0
        out.append(v)
    return out


def z_catalogue(spark, sf):
    # features feed both the scaler fit and the standardisation: materialise once
    f = cut_lineage(features_catalogue(spark, sf))
    stats = H.fit_scaler(f)
    return H.standardise(f, stats), stats


def assigned_catalogue(spark, sf):
    z, stats = z_catalogue(spark, sf)
    return H.assign_cluster(z, _fixed(spark), "kmeans-k6+fixed"), stats


def lloyd_centroids(spark, sf):
    """Centroids derived from the data: the mean z-vector of the months each
    rule-made seed attracts (one Lloyd step). k rows, read from the features."""
    a, stats = assigned_catalogue(spark, sf)
    cents = a.groupBy("cluster").agg(F.array(*[F.avg(f"z_{n}") for n in NAMES]).alias("center"))
    return cents, stats


def labelled_catalogue(spark, sf):
    a, _ = assigned_catalogue(spark, sf)
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("account_id"),
                                               F.col("n_regionkey").alias("truth"))
    return a.join(nation, "account_id")


# --- SQL twins ---------------------------------------------------------------

STATS_SQL = "st AS (SELECT " + ", ".join(
    f"avg({n}) AS mean_{n}, stddev_pop({n}) AS std_{n}" for n in NAMES) + " FROM feat)"
Z_SQL = "z AS (SELECT feat.*, " + ", ".join(
    f"({n} - mean_{n}) / CASE WHEN std_{n} > 0 THEN std_{n} ELSE 1.0 END AS z_{n}" for n in NAMES
) + " FROM feat, st)"


def _dist_sql(center: list[float]) -> str:
    return "sqrt(" + " + ".join(f"(z_{n} - ({v!r})) * (z_{n} - ({v!r}))" for n, v in zip(NAMES, center)) + ")"


ASSIGN_SQL = "d AS (" + " UNION ALL ".join(
    f"SELECT account_id, month, {c} AS cluster, {_dist_sql(v)} AS dist FROM z"
    for c, v in enumerate(_fixed_values())) + """),
asg AS (SELECT account_id, month, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS dist
        FROM d GROUP BY account_id, month)"""
LAB_SQL = "lab AS (SELECT asg.*, n_regionkey AS truth FROM asg JOIN nation ON asg.account_id = n_nationkey)"
BASE = FEAT_CAT + ",\n" + STATS_SQL + ",\n" + Z_SQL
BASE_ASG = BASE + ",\n" + ASSIGN_SQL
BASE_LAB = BASE_ASG + ",\n" + LAB_SQL
CENTS_SQL = ("cents AS (SELECT asg.cluster, [" + ", ".join(f"avg(z.z_{n})" for n in NAMES)
             + "] AS center FROM asg JOIN z ON asg.account_id = z.account_id AND asg.month = z.month"
             + " GROUP BY asg.cluster)")


@query("standardise", BASE + "\nSELECT account_id, " + d10("month") + " AS month, "
       + ", ".join(f"{r6('z_' + n)} AS z_{n}" for n in NAMES) + " FROM z")
def q_standardise(spark, sf):
    z, _ = z_catalogue(spark, sf)
    return flat(z.select("account_id", "month", *[f"z_{n}" for n in NAMES]))


@query("assign_cluster", BASE_ASG + f"""
SELECT account_id, {d10('month')} AS month, CAST(cluster AS BIGINT) AS cluster, {r6('round(dist, 3)')} AS distance_to_centroid,
       'kmeans-k6+fixed' AS model_version FROM asg""")
def q_assign_cluster(spark, sf):
    a, _ = assigned_catalogue(spark, sf)
    return flat(a.select("account_id", "month", F.col("cluster").cast("long").alias("cluster"),
                         "distance_to_centroid", "model_version"))


EVIDENCE_UNPIVOT = " UNION ALL ".join(
    f"SELECT account_id, month, {i} AS pos, '{n}' AS feature, {n} AS v, z_{n} AS zz, mean_{n} AS mu FROM z, st"
    for i, n in enumerate(NAMES))


@query("month_evidence", BASE + f""",
u AS ({EVIDENCE_UNPIVOT}),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id, month ORDER BY abs(zz) DESC, pos ASC) AS rank FROM u)
SELECT account_id, {d10('month')} AS month, rank, feature, {r6('round(v, 3)')} AS your_value,
       {r6('round(mu, 3)')} AS population_average, {r6('round(zz, 2)')} AS std_devs_from_average
FROM r WHERE rank <= 3""")
def q_month_evidence(spark, sf):
    z, stats = z_catalogue(spark, sf)
    ev = H.month_evidence(z, stats)
    return flat(ev.select("account_id", "month", F.posexplode("evidence").alias("p", "e"))
                .select("account_id", "month", (F.col("p") + 1).cast("long").alias("rank"), "e.*"))


@query("cluster_shares", BASE_ASG + f"""
SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS months, {r6('count(*) / (SELECT count(*) FROM asg)')} AS share
FROM asg GROUP BY cluster""")
def q_cluster_shares(spark, sf):
    a, _ = assigned_catalogue(spark, sf)
    return flat(H.cluster_shares(a).withColumn("cluster", F.col("cluster").cast("long")))


_PHRASE_CASE = "CASE feature " + " ".join(
    f"WHEN '{n}' THEN CASE WHEN v > 0 THEN '{hi}' ELSE '{lo}' END" for n, (hi, lo) in H.PHRASES.items()) + " END"
_FEATURE_NAME = "CASE i " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@query("describe_centroid", BASE_ASG + ",\n" + CENTS_SQL + f""",
u AS (SELECT cluster, i, {_FEATURE_NAME} AS feature, center[i + 1] AS v FROM cents, range(0, {len(NAMES)}) t(i)),
r AS (SELECT *, {_PHRASE_CASE} AS phrase,
             row_number() OVER (PARTITION BY cluster ORDER BY abs(v) DESC, i ASC) AS rank
      FROM u WHERE abs(v) >= 0.6),
top AS (SELECT * FROM r WHERE rank <= 3)
SELECT CAST(c.cluster AS BIGINT) AS cluster,
       CASE WHEN count(top.rank) = 0 THEN '{H.CLOSE_TO_AVERAGE}'
            ELSE 'This group ' || string_agg(phrase, ', ' ORDER BY top.rank) || '.' END AS description,
       coalesce(string_agg(top.feature || ':' || CAST(round(top.v, 2) AS VARCHAR), '|' ORDER BY top.rank), '') AS evidence
FROM cents c LEFT JOIN top ON c.cluster = top.cluster GROUP BY c.cluster""")
def q_describe_centroid(spark, sf):
    cents, _ = lloyd_centroids(spark, sf)
    d = H.describe_centroid(cents)
    ev = F.array_join(F.transform("evidence", lambda e: F.concat(
        e["feature"], F.lit(":"), e["std_devs_from_average"].cast("string"))), "|")
    return d.select(F.col("cluster").cast("long").alias("cluster"), "description", ev.alias("evidence"))


@query("centroid_real_units", BASE_ASG + ",\n" + CENTS_SQL + "\nSELECT CAST(cluster AS BIGINT) AS cluster, " + ", ".join(
    f"{r6(f'round(center[{i + 1}] * CASE WHEN std_{n} > 0 THEN std_{n} ELSE 1.0 END + mean_{n}, 3)')} AS {n}"
    for i, n in enumerate(NAMES)) + " FROM cents, st")
def q_centroid_real_units(spark, sf):
    cents, stats = lloyd_centroids(spark, sf)
    return flat(H.centroid_real_units(cents, stats).withColumn("cluster", F.col("cluster").cast("long")))


@query("name_clusters")
def q_name_clusters(spark, sf):
    z, _ = z_catalogue(spark, sf)
    cents, _, _ = H.kmeans_fit(z, K_FIXED, restarts=10)
    return H.name_clusters(cents).select("cluster", "name", "description")


@query("kmeans_fit")
def q_kmeans_fit(spark, sf):
    z, _ = z_catalogue(spark, sf)
    cents, cost, _ = H.kmeans_fit(z, K_FIXED, restarts=10)
    return cents.select("cluster", F.size("center").alias("dims"), F.lit(cost).alias("inertia"))


@query("choose_k")
def q_choose_k(spark, sf):
    z, _ = z_catalogue(spark, sf)
    return H.choose_k(z)


_ZLIST = "[" + ", ".join(f"z_{n}" for n in NAMES) + "]"


@query("silhouette", BASE_ASG + f""",
v AS (SELECT z.account_id, z.month, asg.cluster, {_ZLIST} AS x, list_inner_product({_ZLIST}, {_ZLIST}) AS xx
      FROM z JOIN asg ON z.account_id = asg.account_id AND z.month = asg.month),
c AS (SELECT cluster, count(*) AS n, avg(xx) AS psi, [{', '.join(f'avg(x[{i + 1}])' for i in range(len(NAMES)))}] AS mean FROM v GROUP BY cluster),
pd AS (SELECT v.account_id, v.month, v.cluster = c.cluster AS own, c.n, xx + psi - 2 * list_inner_product(x, mean) AS dist FROM v, c),
s AS (SELECT account_id, month, max(CASE WHEN own AND n > 1 THEN dist * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN dist END) AS b
      FROM pd GROUP BY ALL)
SELECT {r6('avg(CASE WHEN a IS NULL THEN 0.0 WHEN a = b THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_squared_euclidean
FROM s""")
def q_silhouette(spark, sf):
    a, _ = assigned_catalogue(spark, sf)
    return flat(spark.createDataFrame([(H.silhouette(a),)], "silhouette_squared_euclidean double"))


# --- I -----------------------------------------------------------------------

@query("adjusted_rand_index", BASE_LAB + f""",
cells AS (SELECT truth, cluster, count(*) AS n FROM lab GROUP BY ALL),
s AS (SELECT sum(n * (n - 1) / 2.0) AS idx, sum(n) AS total,
             (SELECT sum(a * (a - 1) / 2.0) FROM (SELECT sum(n) AS a FROM cells GROUP BY truth)) AS sa,
             (SELECT sum(b * (b - 1) / 2.0) FROM (SELECT sum(n) AS b FROM cells GROUP BY cluster)) AS sb
      FROM cells),
e AS (SELECT *, sa * sb / (total * (total - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM s)
SELECT {r6('round(CASE WHEN mx - ex = 0 THEN 1.0 ELSE (idx - ex) / (mx - ex) END, 3)')} AS adjusted_rand_index,
       CAST(total AS BIGINT) AS n_months FROM e""")
def q_adjusted_rand_index(spark, sf):
    return flat(J.adjusted_rand_index(labelled_catalogue(spark, sf)))


@query("purity", BASE_LAB + f""",
cells AS (SELECT truth, cluster, count(*) AS n FROM lab GROUP BY ALL),
b AS (SELECT truth, max(n) AS m, sum(n) AS t FROM cells GROUP BY truth)
SELECT {r6('round(sum(m) / sum(t), 3)')} AS purity FROM b""")
def q_purity(spark, sf):
    return flat(J.purity(labelled_catalogue(spark, sf)))


@query("crosstab", BASE_LAB + "\nSELECT CAST(truth AS BIGINT) AS truth, " + ", ".join(
    f"count(*) FILTER (WHERE cluster = {c}) AS cluster_{c}" for c in range(K_FIXED)) + " FROM lab GROUP BY truth")
def q_crosstab(spark, sf):
    return flat(J.crosstab(labelled_catalogue(spark, sf), list(range(K_FIXED))))
