"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import align, ann, counts, decontaminate, ids, jaccard, langid, lm, mix, periods, pieces, secrets, shards
from kontor.llm.scratch import stored
from kontor.sources.tables import table

#: Folder lookup of the public tokenizer files; the file is a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def id_remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), id_remainder(5) != 1)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, id_remainder(4) != 2)
    return langid.predict(docs, model, F.col("doc_id"), (id_remainder(4) == 2).alias("held_out"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path, packs = ids.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return ids.read_store(spark, path, packs)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole table: all documents under the first tokenizer version; deletes of ids
    divisible by 10 and a revision of ids with remainder 3 by 5 to the second version; a late
    re-insert of ids divisible by 20. The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    rollups = counts.Rollups(spark)
    one, two = F.lit("words-1"), F.lit("split-2")
    rollups.apply(1, counts.counted(docs, one))
    change = (counts.counted(docs.filter("doc_id % 5 = 3"), two), docs.filter("doc_id % 10 = 0").select("doc_id"))
    rollups.apply(2, *change)
    rollups.apply(2, *change)
    rollups.apply(3, counts.counted(docs.filter("doc_id % 20 = 0"), two))
    return rollups.totals()


OP8_SQL = r"""
WITH counted AS (
  SELECT source, lang, CASE WHEN doc_id % 5 = 3 OR doc_id % 20 = 0 THEN 'split-2' ELSE 'words-1' END AS version,
         coalesce(text, '') AS t
  FROM documents WHERE doc_id IS NULL OR doc_id % 10 <> 0 OR doc_id % 20 = 0
)
SELECT source, lang, version, count(*) AS docs,
       CAST(sum(CASE WHEN version = 'words-1' THEN len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))
                     ELSE len(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) END) AS BIGINT) AS tokens
FROM counted GROUP BY ALL
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = secrets.scan(table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in base],
                        F.sha2(F.array_join(F.transform(own, text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", text), ",").alias("spans"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents, sharded and written; the digest columns are read from that."""
    rows = stored(shards.shuffled(table(spark, sf_dir, "documents")), "sharded", "zstd")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten get periodic texts: with h the crc32 of the id, g = h / 10 and n words,
    each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Other texts stay as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    a = F.col("_g") % F.col("_n")
    p = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    return (docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumns({"_g": g, "_n": n}).withColumn("_a", a).withColumn("_p", p)
            .withColumn("text", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text"))).drop("_words", "_g", "_n", "_a", "_p"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    order = lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = F.array_min(F.transform("runs", order))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.length")).alias("length"),
        F.col("top.period").alias("period"), F.expr("(1000 * -top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path(PIECE_TOKENIZER)
    texts = pieces.decode_ids(pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    found = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    counted = align.with_counts(found.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_lm_score, op3_nearest, op4_decontaminate, op5_jaccard, op6_language,
                            op7_token_ids, op8_token_counts, op9_secrets, op10_shards, op11_periods, op12_pieces, op13_align, pipeline)}
ORACLE = {"op8_token_counts": OP8_SQL}
