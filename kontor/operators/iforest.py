"""Isolation Forest (Liu, Ting & Zhou 2008) on Spark.

MLlib has no isolation forest, so this is the one place that runs Python:

fit   Each (row, tree) pair is kept with probability p = 2·psi/N, so only about
      2·psi rows per tree are ever materialised (about trees x 2·psi, whatever N
      is). One hash per row first decides whether any tree may take it; only
      those rows draw for the single trees. Rows are
      ranked inside each tree by a further hash and the first psi kept. Trees
      are built in parallel by `groupBy('tree').applyInPandas`, seeded by
      their id, giving a node table (<= trees x (2·psi - 1) rows).
score The node table is a bounded model artifact: it is read once and
      broadcast; an Arrow `pandas_udf` walks all trees for a whole batch
      with numpy (at most ceil(log2 psi) vectorised steps per tree).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions.scan import global_running

TREES = 200
SAMPLE = 256
SEED = 42
CONTAMINATION_GRID = [0.005, 0.01, 0.02, 0.03, 0.05]
CACHED_ROWS = 4096  # rows that walk the trees together: their values stay in the processor's cache
EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("leaf", T.BooleanType()),
])


def average_path_length(n):
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _unit_hash(*cols: Column) -> Column:
    """Deterministic uniform in [0, 1) from the upper 53 bits (all a double holds) of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def _build_tree(tree_id: int, x: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[list] = []

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree_id, me, -1, 0.0, -1, -1, int(idx.size), depth, True])
        if depth >= max_depth or idx.size <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            return me
        f = int(candidates[rng.integers(candidates.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        go_left = sub[:, f] <= thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[me][2:6] = [f, thr, left, right]
        nodes[me][8] = False
        return me

    grow(np.arange(x.shape[0]), 0)
    return [tuple(n) for n in nodes]


def iforest_fit(features: DataFrame, names: list[str], trees: int = TREES, sample: int = SAMPLE,
                seed: int = SEED, id_col: str = "transaction_id") -> tuple[DataFrame, int]:
    """Returns (node table, psi). No scaling; rows are the training rows."""
    n = features.count()
    if n == 0:
        raise ValueError("no training rows")
    psi = min(sample, n)
    p = min(1.0, 2.0 * psi / n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rid = F.col(id_col).cast("string")
    some = min(1.0, trees * p)
    picked = features.filter(_unit_hash(F.lit(seed + 2), rid) < some).select(
        rid.alias("_id"), *[F.col(c).cast("double").alias(c) for c in names],
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                           lambda t: _unit_hash(F.lit(seed), t, rid) < p / some)).alias("tree"))
    ranked = picked.withColumn("_u", _unit_hash(F.lit(seed + 1), F.col("tree"), F.col("_id")))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("_u", "_id")
    sampled = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="mergesort")
        tree_id = int(pdf["tree"].iloc[0])
        rows = _build_tree(tree_id, pdf[names].to_numpy(dtype=float), max_depth, seed)
        return pd.DataFrame(rows, columns=NODE_SCHEMA.fieldNames())

    nodes = sampled.select("tree", "_id", *names).groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    return nodes, psi


class ForestArrays:
    """The trees of a node table (a bounded model artifact) as complete binary trees: the children of node i are 2i + 1 and
    2i + 2, so that a step down is one comparison. What lies below a leaf keeps the leaf's path length."""

    def __init__(self, nodes_pdf: pd.DataFrame, psi: int):
        self.depth = int(nodes_pdf["depth"].max())
        paths = nodes_pdf["depth"].to_numpy() + average_path_length(nodes_pdf["size"].to_numpy())
        nodes_pdf = nodes_pdf.assign(path=paths).sort_values(["tree", "node"])
        trees = [of for _, of in nodes_pdf.groupby("tree")]
        inner = 2**self.depth - 1
        self.feature = np.zeros((len(trees), inner), dtype=np.int64)
        self.threshold = np.full((len(trees), inner), np.inf)
        self.path = np.zeros((len(trees), inner + 1))
        for t, of in enumerate(trees):
            columns = (of[c].tolist() for c in ("node", "feature", "threshold", "left", "right", "leaf", "path"))
            node = {n: rest for n, *rest in zip(*columns, strict=True)}
            todo = [(0, 0, 0)]  # place, its depth, node
            while todo:
                place, depth, n = todo.pop()
                feature, threshold, left, right, leaf, path = node[n]
                if leaf:
                    first = ((place + 1) << (self.depth - depth)) - 1 - inner
                    self.path[t, first:first + (1 << (self.depth - depth))] = path
                else:
                    self.feature[t, place], self.threshold[t, place] = feature, threshold
                    todo += [(2 * place + 1, depth + 1, left), (2 * place + 2, depth + 1, right)]
        self.norm = float(average_path_length([psi])[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape[0])
        for i in range(0, x.shape[0], CACHED_ROWS):
            out[i:i + CACHED_ROWS] = self._score(np.ascontiguousarray(x[i:i + CACHED_ROWS]))
        return out

    def _score(self, x: np.ndarray) -> np.ndarray:
        n, width = x.shape
        total = np.zeros(n)
        values, row = x.ravel(), np.arange(n) * width
        for feature, threshold, path in zip(self.feature, self.threshold, self.path, strict=True):
            if not self.depth:
                total += path[0]
                continue
            # all rows begin at the root: its feature is a column
            place = 2 - (x[:, feature[0]] <= threshold[0])
            for _ in range(self.depth - 1):
                right = ~(values.take(row + feature.take(place)) <= threshold.take(place))
                place += place
                place += 1
                place += right
            total += path.take(place - feature.size)
        mean = total / self.path.shape[0]
        return np.power(2.0, -mean / self.norm) if self.norm > 0 else np.full(n, 0.5)


def iforest_score(features: DataFrame, nodes: DataFrame, psi: int, names: list[str],
                  out_col: str = "anomaly_score") -> DataFrame:
    """2^(-E[path]/c(psi)); higher is more anomalous."""
    spark = features.sparkSession
    pdf = nodes.toPandas()  # <= trees x (2·psi - 1) rows, set by the model's parameters and not by the data
    bc = spark.sparkContext.broadcast(ForestArrays(pdf, psi))

    @F.pandas_udf(T.DoubleType())
    def score_udf(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(bc.value.score(x))

    return features.withColumn(out_col, score_udf(*[F.col(c).cast("double") for c in names]))


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> dict[float, float]:
    """Linear-interpolated quantiles (numpy default) from ONE running count over the
    distinct values, so a value that many rows share is one row; only the handful of
    needed ranks reach the driver."""
    counts = (df.select(F.col(col).cast("double").alias("_x")).filter("_x IS NOT NULL")
              .groupBy("_x").agg(F.count(F.lit(1)).alias("_n")))
    run = global_running(counts, [F.asc("_x")], {"_upto": F.col("_n")}, rank_col="_r")
    n = run.agg(F.max("_upto")).first()[0] or 0
    if n == 0:
        return {q: float("nan") for q in qs}
    need = {}
    for q in qs:
        h = (n - 1) * q
        lo = int(math.floor(h))
        need[q] = (lo, min(lo + 1, n - 1), h - lo)
    ranks = sorted({r + 1 for lo, hi, _ in need.values() for r in (lo, hi)})
    wanted = F.filter(F.array(*[F.lit(r) for r in ranks]),
                      lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_n")))
    got = {int(r["_rank"]): float(r["_x"]) for r in run.select("_x", F.explode(wanted).alias("_rank")).collect()}
    return {q: got[lo + 1] + (got[hi + 1] - got[lo + 1]) * frac for q, (lo, hi, frac) in need.items()}


def contamination_threshold(train_scores: DataFrame, contamination: float,
                            col: str = "anomaly_score") -> float:
    """Flag when score > the (1 - c) quantile of the TRAINING scores."""
    return exact_quantiles(train_scores, col, [1.0 - contamination])[1.0 - contamination]


def tune_contamination(train_scores: DataFrame, val_scored: DataFrame,
                       grid: list[float] = CONTAMINATION_GRID, col: str = "anomaly_score",
                       truth: str = "truth") -> DataFrame:
    """P/R/F1/flag rate on validation for each contamination (one threshold
    per grid value, one aggregation pass); `chosen` = max F1, first on ties."""
    thr = exact_quantiles(train_scores, col, [1.0 - c for c in grid])
    s, t = F.col(col), F.col(truth)
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(t).alias("pos")]
    for i, c in enumerate(grid):
        f = s > F.lit(thr[1.0 - c])
        aggs += [F.count_if(f).alias(f"fl_{i}"), F.count_if(f & t).alias(f"tp_{i}")]
    one = val_scored.agg(*aggs)
    rows = []
    for i, c in enumerate(grid):
        fl, tp = F.col(f"fl_{i}"), F.col(f"tp_{i}")
        p = F.when(fl > 0, tp / fl).otherwise(0.0)
        r = F.when(F.col("pos") > 0, tp / F.col("pos")).otherwise(0.0)
        rows.append(F.struct(F.lit(c).alias("contamination"), F.lit(thr[1.0 - c]).alias("threshold"),
                             F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"),
                             F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 3).alias("f1"),
                             F.round(fl / F.col("rows"), 4).alias("flag_rate"), F.lit(i).alias("position")))
    grid_df = one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    best = grid_df.agg(F.min_by("position", F.struct(-F.col("f1"), F.col("position")))).scalar()
    return grid_df.withColumn("chosen", F.col("position") == best).drop("position")


def model_version(k: int, contamination: float | None = None) -> str:
    """Identifier stamped on every score, from the fitted values (the cluster part alone without a forest)."""
    return f"kmeans-k{k}" + ("" if contamination is None else f"+iforest-c{contamination}")


def score_transactions(features: DataFrame, nodes: DataFrame, psi: int, threshold: float,
                       version: str, names: list[str]) -> DataFrame:
    """Id, score (4 dp), is_anomaly, reasons, model version.

    N1 (names) is a schema check; N2 is an assert inside the job, so one
    non-finite value fails the whole batch (all or nothing). Features that come with the `anomaly_score` these
    trees gave them are not scored again.
    """
    from kontor.operators.contracts import assert_finite, feature_contract
    from kontor.operators.explain import explain_flags
    feature_contract(features.select(*names), names)
    checked = assert_finite(features, names)
    scored = checked if "anomaly_score" in features.columns else iforest_score(checked, nodes, psi, names)
    flagged = scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(threshold))
    return (explain_flags(flagged, "is_anomaly")
            .select("transaction_id", "account_id", F.round("anomaly_score", 4).alias("anomaly_score"),
                    "is_anomaly", "reasons", F.lit(version).alias("model_version")))
