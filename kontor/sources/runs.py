"""Tables of sorted runs behind an atomic manifest: merge on read, compaction, conflict checks.

A table is a folder of runs and numbered manifests. Each commit adds one run with its own rows alone; readers take the runs
that the highest manifest lists and fold the entries of a key in commit order. Runs that are not several times larger
than what follows them are merged into the new one, so a table keeps about log(rows) runs and a row is rewritten
about log(rows) times, whatever the number of commits. Runs are sorted by key, so files and row groups hold key ranges that filters skip.

A manifest is written aside and renamed to its number, which fails if another writer took it: then nothing of this commit
shows, and `commit` folds its entries onto the other writer's table again. A job that ends before the rename leaves the
table as it was; `vacuum` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.session import cut_lineage

GROWTH = 4
TASK_ROWS = 1_000_000
ATTEMPTS = 20


def by_rows(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """`n` rows dealt by key to tasks of about TASK_ROWS each, so that a task's memory does not follow the size of the input;
    as they are where one task can hold them."""
    return rows if n <= TASK_ROWS else rows.repartition(-(-n // TASK_ROWS), *keys)


class Conflict(RuntimeError):
    """Another writer committed first."""


class RunTable:
    """`fold(entries, whole)` makes one row per key from entries with `_seq`; `whole`: nothing lies below them.
    Without a schema, that of the oldest run is taken."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType | None, keys: list[str], fold: Callable[[DataFrame, bool], DataFrame]):
        self.spark, self.path, self.keys, self.fold = spark, path.rstrip("/"), keys, fold
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.hadoop = spark._jvm.org.apache.hadoop
        self.root = self.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        if schema is None:
            self.schema = spark.read.parquet(f"{self.path}/{self.state()[1][0]['path']}").schema

    # --- manifests ---------------------------------------------------------------------------

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self._path("manifest")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def state(self) -> tuple[int, list[dict]]:
        """The last commit's number (0 before the first) and its runs, oldest first."""
        numbers = self._numbers()
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/manifest/{numbers[-1]}.json", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)["runs"]

    def committed(self) -> DataFrame:
        """sync: the names of all committed changes."""
        if not self._numbers():
            return self.spark.createDataFrame([], "sync string")
        return self.spark.read.schema("sync string").json(f"{self.path}/manifest").select("sync")

    def _swap(self, number: int, runs: list[dict], sync: str) -> None:
        aside, target = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/{number}.json")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps({"sync": sync, "runs": runs}).encode()))
        out.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), options)
        except Exception as refused:
            self.fs.delete(aside, False)
            if self.fs.exists(target):
                raise Conflict(f"{self.path}: commit {number} exists") from refused
            raise

    # --- rows --------------------------------------------------------------------------------

    def _entries(self, runs: list[dict]) -> DataFrame:
        """All entries of some runs with `_seq`, the run's place in commit order."""
        out = self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0).cast("long"))
        for run in runs:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{run['path']}").withColumn("_seq", F.lit(run["seq"]).cast("long")))
        return out

    def read(self) -> DataFrame:
        """One row per key. The oldest run's rows are joined with the newer runs' keys; only rows of these are folded."""
        _, runs = self.state()
        oldest = self._entries(runs[:1])
        if len(runs) < 2:
            return self.fold(by_rows(oldest, runs[0]["rows"], self.keys), True) if runs else oldest.drop("_seq")
        newer = self._entries(runs[1:])
        keys = newer.select(*self.keys).distinct()
        same = lambda df: [df[k].eqNullSafe(keys[k]) for k in self.keys]
        touched = oldest.join(keys, same(oldest), "left_semi")
        # a newer run's row meets at most one row of the oldest
        met = by_rows(touched.unionByName(newer), 2 * sum(run["rows"] for run in runs[1:]), self.keys)
        return oldest.join(keys, same(oldest), "left_anti").drop("_seq").unionByName(self.fold(met, True))

    def commit(self, entries: DataFrame, sync: str | None = None) -> int:
        """Add the entries (one per key) as a commit; how many rows were written, merged runs included."""
        sync, written = sync or uuid.uuid4().hex, 0
        own, n = None, 0
        for _ in range(ATTEMPTS):
            number, runs = self.state()
            if own is None:  # kept if another writer is first
                own, n = self._write(entries)
                written += n
            keep, rows = len(runs), n
            while keep and runs[keep - 1]["rows"] < GROWTH * rows:
                keep -= 1
                rows += runs[keep]["rows"]
            new = [{"path": own, "rows": n, "seq": number + 1}]
            merged = new
            if keep < len(runs):
                path, rows = self._write(self.fold(by_rows(self._entries(runs[keep:] + new), rows, self.keys), keep == 0))
                merged, written = [{"path": path, "rows": rows, "seq": number + 1}], written + rows
            try:
                self._swap(number + 1, runs[:keep] + merged, sync)
                return written
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers were first {ATTEMPTS} times")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        path = f"data/{uuid.uuid4().hex}"
        staged = cut_lineage(rows.select(*self.schema.fieldNames()))  # its rows are counted and sampled before they are sorted
        n = staged.count()
        (staged.repartitionByRange(*([-(-n // TASK_ROWS)] if n > TASK_ROWS else []), *self.keys).sortWithinPartitions(*self.keys)
         .write.parquet(f"{self.path}/{path}"))
        return path, n

    def vacuum(self) -> int:
        """Delete runs that the last manifest doesn't name; how many went. Not while others read or write."""
        kept = {r["path"].split("/")[1] for r in self.state()[1]}
        gone = 0
        for run in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []:
            if run.getPath().getName() not in kept:
                self.fs.delete(run.getPath(), True)
                gone += 1
        return gone


def latest(keys: list[str]) -> Callable[[DataFrame, bool], DataFrame]:
    """A fold that keeps each key's newest entry."""
    def fold(entries: DataFrame, whole: bool) -> DataFrame:
        rest = [c for c in entries.columns if c not in (*keys, "_seq")]
        return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_row")).select(*keys, "_row.*")
    return fold


def summed(keys: list[str], value: str) -> Callable[[DataFrame, bool], DataFrame]:
    """A fold that adds a count up."""
    return lambda entries, whole: entries.groupBy(*keys).agg(F.sum(value).alias(value))
