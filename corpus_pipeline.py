"""A training corpus from raw documents, in five stages.

Every stage is a function of (spark, docs, sf_dir); its rows are written as Parquet
and read again as the next stage's documents. All but the last return the columns of
`documents`: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import decontaminate, jaccard, langid, mix, shards
from kontor.llm.queries import id_remainder
from kontor.llm.scratch import stored
from kontor.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text, or no letter in it) go; `lang` becomes the predicted one."""
    model = langid.fit(docs, id_remainder(4) != 2)
    found = langid.predict(docs, model, *[F.col(c) for c in COLUMNS])
    return (found.filter(F.col("lang_pred") != langid.UNKNOWN)
            .select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a `row_key` for each row, written once: ids may be null or repeat.
    xxhash64 of a single long is a bijection, so keys are distinct, and even in their low bits."""
    return stored(docs.select(*COLUMNS, F.xxhash64(F.monotonically_increasing_id()).alias("row_key")), "pipeline-rows", "zstd")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near duplicates the one with the smallest id stays (null last, then by row); rows that only
    share an id are no duplicates; rows without words are no duplicates of anything."""
    rows = keyed(docs)
    groups = stored(jaccard.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"))
                    .withColumnRenamed("doc_id", "row_key"), "pipeline-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    kept = (groups.filter("n_shingles > 0").join(rows.select("row_key", "doc_id"), "row_key")
            .groupBy("component_id").agg(first.alias("first")).select("first.row_key")
            .union(groups.filter("n_shingles = 0").select("row_key")))
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, whatever their id; other rows with that id stay."""
    rows = keyed(docs)
    pairs = decontaminate.contaminated(rows.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(pairs.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: what each pass over a source takes of a document, up to three rows for one."""
    return mix.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, laid out in that order."""
    return shards.shuffled(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages are not expressible in SQL (automata, draws); tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
