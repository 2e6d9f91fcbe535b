"""Batched k-means: all models (k, restart) take part in every pass over the rows.

A pass is one job: each task reads its rows as Arrow batches, adds up per model and cluster, and emits those sums once; Spark
adds the tasks' sums. So many models cost as many passes as the slowest one needs, and what is shuffled or
collected has one row for each model and cluster, whatever the number of rows.

Seeds are k-means++ draws: a row's chance is its squared distance to the seeds so far, drawn as the smallest of
exponential keys (-log u / distance), u a hash of the row's number, restart and step. The first k seeds of a
restart serve every k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.session import cut_lineage

MAX_ITERATIONS = 300
TOLERANCE = 1e-4
SAMPLE = 2000


@dataclass
class Fit:
    """One model: centers (k x d), inertia, rows and vector sums of its clusters at those centers."""

    k: int
    restart: int
    centers: np.ndarray
    inertia: float = np.inf
    counts: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    passes: int = 0


def vector_table(rows: DataFrame, vector: Column, *keep: str) -> DataFrame:
    """id (stable: the table is written once), v and the kept columns."""
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("id"), vector.alias("v"), *keep))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centers."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0.0)


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row: a finaliser of its number and the seed."""
    x = ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def seeds(data: DataFrame, restarts: int, k: int, seed: int) -> list[np.ndarray]:
    """For each restart the first k k-means++ seeds (fewer distinct rows than k: the last one repeats)."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(k):
        so_far = [np.array(c) for c in chosen]

        def race(batches: Iterator[pa.RecordBatch], so_far: list = so_far, step: int = step) -> Iterator[pa.RecordBatch]:
            best: list = [(np.inf, -1, None)] * restarts
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for r in range(restarts):
                    weight = _squared(x, so_far[r]).min(1) if step else np.ones(ids.size)
                    with np.errstate(divide="ignore"):
                        key = np.where(weight > 0, -np.log(_uniform(ids, seed * 1_000_003 + r * 1009 + step)) / weight, np.inf)
                    i = int(key.argmin())
                    if key[i] < best[r][0]:
                        best[r] = (float(key[i]), int(ids[i]), x[i].tolist())
            found = [(r, *b) for r, b in enumerate(best) if b[2] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (
                pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["restart", "key", "id", "v"])

        winners = (data.select("id", "v").mapInArrow(race, "restart int, key double, id long, v array<double>")
                   .groupBy("restart").agg(F.min_by("v", F.struct("key", "id")).alias("v")).collect())
        of = {w.restart: np.array(w.v) for w in winners}
        for r in range(restarts):
            if r in of:
                chosen[r].append(of[r])
            elif chosen[r]:
                chosen[r].append(chosen[r][-1])
    return [np.array(c) for c in chosen]


def _pass(data: DataFrame, fits: list[Fit]) -> None:
    """Counts, sums and costs of every fit's clusters at its centers."""
    stacked, sizes = np.vstack([f.centers for f in fits]), [f.k for f in fits]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    d = stacked.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(edges[-1]), np.zeros((edges[-1], d))
        squares, costs = np.zeros(edges[-1]), np.zeros(edges[-1])
        for batch in batches:
            x = _matrix(batch.column(0))
            if not x.size:
                continue
            far, norm = _squared(x, stacked), (x * x).sum(1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                near = far[:, a:b].argmin(1)
                member = np.zeros((x.shape[0], b - a))
                member[np.arange(x.shape[0]), near] = 1.0
                counts[a:b] += member.sum(0)
                sums[a:b] += member.T @ x
                squares[a:b] += norm @ member
                costs[a:b] += far[np.arange(x.shape[0]), a + near] @ member
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(edges[-1])), pa.array(counts), pa.array(squares), pa.array(costs), *[pa.array(s) for s in sums.T]],
                                         names=["at", "n", "squares", "cost", *[f"s{i}" for i in range(d)]])

    sum_columns = [f"s{i}" for i in range(d)]
    found = (data.select("v").mapInArrow(add, "at long, n double, squares double, cost double, " + ", ".join(f"{c} double" for c in sum_columns))
             .groupBy("at").agg(*[F.sum(c).alias(c) for c in ["n", "squares", "cost", *sum_columns]]).collect())
    total = np.zeros((edges[-1], d + 3))
    for r in found:
        total[r["at"]] = [r["n"], r["squares"], r["cost"], *[r[c] for c in sum_columns]]
    for fit, a, b in zip(fits, edges[:-1], edges[1:], strict=True):
        fit.counts, fit.squares, fit.inertia, fit.sums = total[a:b, 0], total[a:b, 1], float(total[a:b, 2].sum()), total[a:b, 3:]
        fit.passes += 1


def fit_all(data: DataFrame, ks: list[int], restarts: int, seed: int) -> list[Fit]:
    """Every k with every restart, run until no center moves further than TOLERANCE. Empty clusters keep their center."""
    start = seeds(data, restarts, max(ks), seed)
    fits = [Fit(k, r, start[r][:k].copy()) for k in ks for r in range(restarts) if start[r].size]
    if not fits:
        raise ValueError("no rows to cluster")
    going = fits
    for _ in range(MAX_ITERATIONS):
        _pass(data, going)
        moved = []
        for fit in going:
            full = fit.counts > 0
            new = fit.centers.copy()
            new[full] = fit.sums[full] / fit.counts[full, None]
            if np.sqrt(((new - fit.centers) ** 2).sum(1).max()) > TOLERANCE:
                fit.centers = new
                moved.append(fit)
        if not moved:
            return fits
        going = moved
    _pass(data, going)
    return fits


def best_of(fits: list[Fit], k: int) -> Fit:
    """The restart with the lowest inertia, the first on ties."""
    return min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.restart))


def squared_silhouettes(data: DataFrame, fits: list[Fit]) -> list[float]:
    """Mean silhouette by squared distances of every fit, in one pass: a row's mean squared distance to a cluster
    follows from the cluster's count, sum and squares."""
    parts = [(f.centers, f.counts, f.sums, f.squares) for f in fits]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(parts)), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if not x.size:
                continue
            rows += x.shape[0]
            norm, at = (x * x).sum(1), np.arange(x.shape[0])
            for m, (centers, n, s, q) in enumerate(parts):
                own = _squared(x, centers).argmin(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = np.where(n > 0, norm[:, None] + q / n - 2 * x @ (s / n[:, None]).T, np.inf)
                    inside = mean[at, own] * n[own] / (n[own] - 1)
                    mean[at, own] = np.inf
                    other = mean.min(1)
                    score = np.where((n[own] > 1) & np.isfinite(other), (other - inside) / np.maximum(inside, other), 0.0)
                sums[m] += np.nan_to_num(score).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(sums), pa.array(np.full(len(parts), float(rows)))], names=["at", "s", "n"])

    found = data.select("v").mapInArrow(add, "at long, s double, n double").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    of = {r["at"]: r.s / r.n if r.n else 0.0 for r in found}
    return [of[m] for m in range(len(fits))]


def euclidean_silhouette(data: DataFrame, sample: int = SAMPLE) -> tuple[float, float, int]:
    """Mean silhouette by Euclidean distances over a stratified sample of rows, each against all rows: (value, standard
    error, rows sampled). data: id, v, cluster. At most about `sample` rows are drawn, every cluster in proportion with
    two at least; if the table has no more, all are and the value is exact (error 0)."""
    sizes = {r["cluster"]: r["n"] for r in data.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return 0.0, 0.0, 0
    take = {c: n if total <= sample else min(n, max(2, sample * n // total)) for c, n in sizes.items()}
    draw = F.xxhash64(F.col("id"))
    bounds = {c: (2 * t / sizes[c] if t < sizes[c] else 2.0) for c, t in take.items()}  # about twice the share, then cut
    share = F.create_map(*[F.lit(x) for c, b in bounds.items() for x in (c, float(b))])[F.col("cluster")]
    picked = (data.withColumn("_h", draw).filter((F.col("_h").cast("double") / float(2**64) + 0.5) <= share)
              .select("id", "v", "cluster", "_h").orderBy("cluster", "_h").collect())
    mine: dict = {}
    for r in picked:
        if len(mine.setdefault(r["cluster"], [])) < take[r["cluster"]]:
            mine[r["cluster"]].append(r["v"])
    order = sorted(sizes)
    points = np.array([v for c in order for v in mine.get(c, [])])
    of = np.array([i for i, c in enumerate(order) for _ in mine.get(c, [])])
    place = {c: i for i, c in enumerate(order)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((points.shape[0], len(order)))
        for batch in batches:
            x, c = _matrix(batch.column(0)), np.array([place[c] for c in batch.column(1).to_pylist()], np.int64)
            for i in range(0, x.shape[0], 512):
                far = np.sqrt(((points[:, None, :] - x[None, i:i + 512]) ** 2).sum(2))
                member = np.zeros((far.shape[1], len(order)))
                member[np.arange(far.shape[1]), c[i:i + 512]] = 1.0
                sums += far @ member
        at = np.arange(points.shape[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(s) for s in sums.T]], names=["at", *[f"d{j}" for j in range(len(order))]])

    names = [f"d{j}" for j in range(len(order))]
    found = (data.select("v", "cluster").mapInArrow(add, "at long, " + ", ".join(f"{n} double" for n in names))
             .groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect())
    n = np.array([sizes[c] for c in order], float)
    distance = np.zeros((points.shape[0], len(order)))
    for r in found:
        distance[r["at"]] = [r[c] for c in names]
    at = np.arange(points.shape[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = distance[at, of] / (n[of] - 1)
        mean = distance / n
        mean[at, of] = np.inf
        other = mean.min(1)
        score = np.nan_to_num(np.where(n[of] > 1, (other - inside) / np.maximum(inside, other), 0.0))
    value = error = 0.0
    for i, c in enumerate(order):
        s, weight = score[of == i], n[i] / n.sum()
        value += weight * s.mean()
        if s.size < n[i] and s.size > 1:
            error += weight ** 2 * s.var(ddof=1) / s.size * (1 - s.size / n[i])
    return float(value), float(np.sqrt(error)), int(points.shape[0])
