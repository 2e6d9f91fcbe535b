"""Token counts as delta-maintained rollups.

State is two kinds of files in one folder: `ledger` (the current counted
version of every document: source, language, tokenizer version, tokens) and
`deltas` (per batch, the signed change of documents and tokens by source,
language and tokenizer version). A batch holds inserts, deletes and revised
documents; a revision is a delete of the old version and an insert of the new
one, so totals are a plain sum of deltas and are never recomputed from texts.

Commits: a batch writes its delta and the touched part of the ledger under its own
number, then a row in `commits` with the next place in the order of commits. Readers sum only committed batches; a batch
number that is already committed is skipped, and one that failed half-way is
overwritten by its repeat, so applying a batch again changes nothing. A document's current
version is that of the last commit, not of the highest number: batches may come in any order of their numbers.
One writer commits at a time.

Defined cases: null text has 0 tokens and still counts as a document; null
source or language are groups of their own; deletes of unknown documents change
nothing; of several rows for one document in a batch a delete comes first and, of
inserts, the one with the largest text hash counts; every row with a null doc_id counts as a document
that can't be revised or deleted; long texts are counted whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm.scratch import scratch_dir

#: Tokenizer versions of the rollups, as counting expressions over the text.
VERSIONS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "split-2": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")),
}
KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, tokens long, live boolean, batch long"
COMMITS = "batch long, place long"
DELTA = "source string, lang string, version string, docs long, tokens long, batch long"


def counted(docs: DataFrame, version: Column, counters=VERSIONS) -> DataFrame:
    """Documents with their token count under the version that `version` names."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.lit(None).cast("long")
    for name, count in counters.items():
        tokens = F.when(version == name, count(text).cast("long")).otherwise(tokens)
    return docs.select("doc_id", "source", "lang", version.alias("version"), tokens.alias("tokens"),
                       F.xxhash64("text").alias("text_hash"))


class Rollups:
    """Totals by source, language and tokenizer version under `path`."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_dir(spark, "rollups")

    def _read(self, what: str, schema: str) -> DataFrame:
        path = f"{self.path}/{what}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def commits(self) -> DataFrame:
        """batch and its place in the order of commits."""
        return self._read("commits", COMMITS)

    def ledger(self) -> DataFrame:
        """The live version of every document: of its rows in committed batches the last committed."""
        rows = self._read("ledger", LEDGER).filter("doc_id IS NOT NULL").join(self.commits(), "batch")
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("source", "lang", "version", "tokens", "live"), "place").alias("r"))
        return last.select("doc_id", "r.*").filter("live").drop("live")

    def apply(self, batch: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit one batch; False if it was committed before. inserts: rows of `counted` (new or
        revised documents); deletes: doc_id."""
        if not self.commits().filter(F.col("batch") == batch).isEmpty():
            return False
        done = self.commits().agg(F.max("place")).first()[0] or 0
        new = self.spark.createDataFrame([], LEDGER).drop("live", "batch")
        if inserts is not None:
            pick = F.max_by(F.struct(*KEYS, "tokens"), F.struct(F.coalesce("text_hash", F.lit(0)), *KEYS, "tokens"))
            new = (inserts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(pick.alias("r")).select("doc_id", "r.*"))
        touched = new.select("doc_id", *KEYS, "tokens", F.lit(True).alias("live"))
        if inserts is not None:
            touched = touched.unionByName(inserts.filter("doc_id IS NULL").select(*touched.columns[:-1], F.lit(True).alias("live")))
        if deletes is not None:
            gone = deletes.filter("doc_id IS NOT NULL").select("doc_id").distinct().join(new, "doc_id", "left_anti")
            touched = touched.unionByName(gone.select("doc_id", F.lit(False).alias("live")), allowMissingColumns=True)
        # the batch's part of the ledger is written first and read back, so texts are counted once
        part = f"{self.path}/ledger/batch={batch}"
        touched.withColumn("tokens", F.col("tokens").cast("long")).write.mode("overwrite").parquet(part)
        touched = self.spark.read.schema(touched.schema).parquet(part)
        signed = touched.filter("live").select(*KEYS, F.lit(1).alias("sign"), "tokens")
        if done:
            old = self.ledger().join(touched.select("doc_id"), "doc_id", "left_semi")
            signed = signed.unionByName(old.select(*KEYS, F.lit(-1).alias("sign"), "tokens"))
        delta = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"),
                                          F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(done + 1).cast("long").alias("place")).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups without documents are gone."""
        rows = self._read("deltas", DELTA).join(self.commits().select("batch"), "batch", "left_semi")
        return (rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .filter("docs <> 0 OR tokens <> 0"))
