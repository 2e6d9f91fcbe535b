"""Mixing sources to target weights.

Every source is one stream of words, packed into blocks of a fixed number of
words. The output is a sequence of slots, cut into output shards. For each
shard a multinomial draw over the sources says how many of its slots each
source fills; the k-th slot of a source takes the block that a pseudorandom
permutation of the source's block numbers (a new one for every pass over the
source) gives for k, and blocks and slots meet in a join on (source, block). `mixed_blocks`
is that output, words included; `taken` counts the words that lie in its blocks.

Targets: weights repeat over the sources in code point order, share all words,
and stop at `limit` times the source; what is above goes to the others by weight.
The draws alone would miss the targets by a square-root error, and could exceed
the limit, so a source's slots beyond its quota go to sources short of theirs:
quotas are then met exactly, while almost all slots keep their draw.

Everything is DataFrame expressions. No step groups rows by source alone: a
source's stream is laid out by granules of about GRANULE documents, dealt by id and
text, so that rows which share an id (or have none) do not share a granule.

Defined cases: null text or text without words has size 0, is in no block and is
never taken; a null source is a source of its own, last in order; repeated rows
are separate rows of the stream; without any words all targets are 0 and no slot
is made; columns of the input other than those named here don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.permute import permuted
from kontor.llm.ranges import in_range
from kontor.llm.scratch import stored

BLOCK = 64
SHARD_SLOTS = 16384
GRANULE = 4096
WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def laid_out(docs: DataFrame, granules: int, *more: str) -> DataFrame:
    """Rows with their size, granule and a hash that orders equal ids; `more`: columns to keep."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", *more, F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(granules)).cast("int").alias("granule"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with `place`, their number inside (source, granule)."""
    order = Window.partitionBy("source", "granule").orderBy("doc_id", "text_hash")
    return rows.withColumn("place", F.row_number().over(order))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT,
            block: int = BLOCK) -> DataFrame:
    """One row per source: its words, target, blocks and quota of slots with its start among all quotas.

    The water level of the capped shares is found in one pass: with sources ordered by
    cap / weight, the level that leaves the first i capped is (words - their caps) / other weights,
    and its largest value is the fixed point of resharing.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = (by_source
              .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("words", F.sum("source_size").over(everything))
              .withColumn("cap", F.col("source_size") * float(limit)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shared = (ranked.withColumn("level", level)
              .withColumn("level", F.max("level").over(everything))
              .withColumn("target", F.least("cap", F.col("level") * F.col("weight"))))
    blocks = F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")
    quota = F.least(F.lit(limit) * F.col("blocks"),
                    F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long"))
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return (shared.withColumn("blocks", blocks)
            .withColumn("quota", F.coalesce(quota, F.lit(0).cast("long")))
            .withColumn("quota_start", F.coalesce(F.sum("quota").over(by_rank), F.lit(0).cast("long")))
            .select("rank", "source", "source_size", "target", "blocks", "quota", "quota_start"))


def draw_slots(plan: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, rank, pass, block) for every output slot."""
    spark = plan.sparkSession
    quotas = plan.select("rank", "quota", "quota_start", "blocks")
    # one draw per slot, counted: multinomial counts per shard
    draws = (spark.range(slots)
             .withColumn("shard", F.floor(F.col("id") / shard_slots).cast("long"))
             .withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots))))
    drawn = in_range(draws, "draw", quotas.select("rank", "quota", "quota_start"), "quota_start", "quota", F.lit(slots))
    cells = stored(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")), "mix-counts")
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = (cells.withColumn("k0", F.coalesce(F.sum("n").over(earlier), zero))
             .withColumn("at0", F.coalesce(F.sum("n").over(left), zero))
             .withColumn("shard_n", F.sum("n").over(Window.partitionBy("shard"))))
    totals = cells.groupBy("rank").agg(F.sum("n").alias("drawn"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ledger = (quotas.join(totals, "rank", "left").fillna(0, ["drawn"])
              .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), zero))
              .withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), zero))
              .withColumn("over_start", F.coalesce(F.sum("over").over(before), zero))
              .withColumn("short_start", F.coalesce(F.sum("short").over(before), zero)))
    # cells are few bytes but stand for all slots: they are spread before they expand
    spread = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "rank")
    each = (spread.withColumn("i", F.explode(F.sequence(zero, F.col("n") - 1)))
            .select("shard", "rank", "shard_n", (F.col("k0") + F.col("i")).alias("k"), (F.col("at0") + F.col("i")).alias("at"))
            .join(ledger.select("rank", "quota", "blocks", "over_start"), "rank"))
    kept = each.filter(F.col("k") < F.col("quota")).select("shard", "shard_n", "at", "rank", "k", "blocks")
    spare = (each.filter(F.col("k") >= F.col("quota"))
             .select("shard", "shard_n", "at", (F.col("over_start") + F.col("k") - F.col("quota")).alias("e")))
    moved = in_range(spare, "e", ledger.select("rank", "blocks", "drawn", "short", "short_start"),
                     "short_start", "short", F.lit(slots))
    moved = moved.select("shard", "shard_n", "at", "rank",
                         (F.col("drawn") + F.col("e") - F.col("short_start")).alias("k"), "blocks")
    turn = F.floor(F.col("k") / F.col("blocks")).cast("long")
    return (kept.unionByName(moved).withColumn("pass", turn)
            .select("shard",
                    permuted(F.col("at"), F.col("shard_n"), F.lit(seed + 1), F.col("shard")).alias("slot"),
                    "rank", "pass",
                    permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed + 2), F.col("rank"),
                             F.col("pass")).alias("block")))


class _Layout:
    """The rows of a table with their places in their sources' streams, and the targets per source."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...], limit: int, block: int):
        self.docs, self.granules = docs, docs.count() // GRANULE + 1
        rows = stored(numbered(laid_out(docs, self.granules)), "mix-rows")
        self.plan = stored(targets(rows, weights, limit, block), "mix-plan")
        self.slots = self.plan.agg(F.sum("quota")).first()[0] or 0
        self.rows = self.ranked(rows)
        zero = F.lit(0).cast("long")
        across = Window.partitionBy("rank").orderBy("granule").rowsBetween(Window.unboundedPreceding, -1)
        #: Words before a granule in its source's stream.
        self.bases = stored(self.rows.groupBy("rank", "granule").agg(F.sum("size").alias("words"))
                            .select("rank", "granule", F.coalesce(F.sum("words").over(across), zero).alias("base")), "mix-bases")

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's rank."""
        named = self.plan.select("rank", F.col("source").alias("_s"))
        return rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def streamed(self, rows: DataFrame) -> DataFrame:
        """Ranked rows with `start`, the number of their first word in their source's stream."""
        inside = Window.partitionBy("rank", "granule").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        return (rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
                .join(self.bases, ["rank", "granule"])
                .withColumn("start", F.col("start") + F.col("base")))


def _block_numbers(block: int) -> Column:
    """Numbers of the blocks in which a row has words."""
    return F.sequence(F.floor(F.col("start") / block).cast("long"),
                      F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, rows, plan).

    placed: one row per slot and document part in it: shard, slot, pass, block and the part
    (granule, place and rank name the document row; `first` its first word, `n` its words).
    rows: the document rows with size and their names; plan: the targets per source.
    """
    layout = _Layout(docs, weights, limit, block)
    begin = F.greatest(F.col("block") * block, F.col("start"))
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    parts = (layout.streamed(layout.rows).filter("size > 0")
             .withColumn("block", F.explode(_block_numbers(block)))
             .select("rank", "block", "granule", "place", "doc_id",
                     (begin - F.col("start")).alias("first"), (end - begin).alias("n")))
    # neither side is bounded, and runs of numbers shuffle in few bytes: no broadcast by that size
    placed = draw_slots(layout.plan, layout.slots, shard_slots, seed).join(parts.hint("merge"), ["rank", "block"])
    return placed, layout.rows, layout.plan


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK,
                 shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, rows, plan): the mix itself, one row per slot of an output shard, and `rows` and `plan` as in `mix`.

    blocks: shard, slot, rank, pass, block and `parts`, the documents' pieces in the order of the stream (granule and place
    name the document row; `words` are its words in that block, with the white space behind each). The pieces of a
    block hold `block` words together; the last block of a source may hold fewer.
    """
    layout = _Layout(docs, weights, limit, block)
    place = Window.partitionBy("rank", "granule").orderBy("doc_id", "text_hash")
    rows = layout.ranked(laid_out(docs, layout.granules, "text")).withColumn("place", F.row_number().over(place))
    streamed = layout.streamed(rows).filter("size > 0")

    def piece(words: Column) -> Callable[[Column], Column]:
        def cut(b: Column) -> Column:
            first = F.greatest(b * block - F.col("start"), F.lit(0).cast("long"))
            end = F.least((b + 1) * block - F.col("start"), F.col("size"))
            cut_out = F.array_join(F.slice(words, (first + 1).cast("int"), (end - first).cast("int")), "")
            return F.struct(b.alias("block"), cut_out.alias("words"))
        return cut

    # a text is split once: `words` is a variable of the outer function, not an expression that each piece repeats
    split = F.array(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)))
    pieces = F.flatten(F.transform(split, lambda words: F.transform(_block_numbers(block), piece(words))))
    packed = (streamed.select("rank", "granule", "place", "doc_id", F.explode(pieces).alias("piece"))
              .groupBy("rank", F.col("piece.block").alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("granule", "place", "doc_id", F.col("piece.words").alias("words")))).alias("parts")))
    slots = draw_slots(layout.plan, layout.slots, shard_slots, seed)
    return slots.join(packed.hint("merge"), ["rank", "block"]), layout.rows, layout.plan


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per document row: its size, its source's size and target, and its words in the blocks of the mix."""
    blocks, rows, plan = mixed_blocks(docs, **how)
    words = (blocks.select("rank", F.explode("parts").alias("part"))
             .groupBy("rank", F.col("part.granule").alias("granule"), F.col("part.place").alias("place"))
             .agg(F.sum(F.regexp_count("part.words", F.lit(WORD))).alias("taken")))
    return (rows.join(words.hint("merge"), ["rank", "granule", "place"], "left")
            .join(plan.select("rank", "source_size", "target"), "rank")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: for every pass over a source, one row per document with the words
    that this pass takes of it, in their order and with the white space behind them."""
    placed, rows, _ = mix(docs, **how)
    granules = docs.count() // GRANULE + 1
    wide = docs.select(
        "doc_id", "source", "text", "lang", F.xxhash64("text").alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(granules)).cast("int").alias("granule"))
    picks = (placed.groupBy("rank", "granule", "place", "pass")
             .agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("parts"))
             .join(rows.select("rank", "granule", "place", "source"), ["rank", "granule", "place"])
             .groupBy("source", "granule", "place")
             .agg(F.collect_list("parts").alias("passes")))
    # texts and picks move together, once, to the task of their granule: a join by place would move the texts again
    dealt = (wide.withColumn("picked", F.lit(False))
             .unionByName(picks.withColumn("picked", F.lit(True)), allowMissingColumns=True).repartition("source", "granule"))
    order = Window.partitionBy("source", "granule", "picked").orderBy("doc_id", "text_hash")
    at = Window.partitionBy("source", "granule", "place").orderBy(F.desc("picked")).rowsBetween(Window.unboundedPreceding, 0)
    whole = (dealt.withColumn("place", F.when(F.col("picked"), F.col("place")).otherwise(F.row_number().over(order)))
             .withColumn("passes", F.first("passes").over(at)).filter(~F.col("picked") & F.col("passes").isNotNull()))
    spaced = whole.withColumn("words", F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)))
    texts = F.transform("passes", lambda parts: F.array_join(F.flatten(F.transform(
        parts, lambda p: F.slice(F.col("words"), (p["first"] + 1).cast("int"), p["n"].cast("int")))), ""))
    return (spaced.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))
