"""Mixing, sharding, counts: the operators in DataFrame expressions."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kontor.llm import counts, mix, queries, shards
from kontor.llm.permute import permuted
from tests.llm.conftest import CLASHING, WORDS, edge_rows, listed, prose

PYTHON = ("Python", "Pandas", "Arrow")


def size(text):
    return len(WORDS.findall(text or ""))


def water_fill(sizes: dict, weights: dict, limit: int) -> dict:
    """Share by weight, cap, reshare, until none is above."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weights.items() if s not in capped}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: limit * sizes[s] for s in share if share[s] > limit * sizes[s]}
        if not over:
            return capped | share
        capped |= over


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5), F.lit("key")).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert got != list(range(n)) and sum(abs(g - i) for i, g in enumerate(got)) > n * n / 5


def documents(spark, sizes: dict[str | None, list[int]]):
    rows, i = [], 0
    for source, lens in sizes.items():
        for n in lens:
            rows.append((i, prose(i, n), "en", source, n))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_meets_targets_and_limits(spark):
    sizes = {"a": [400] * 30, "b": [30] * 40, "c": [900] * 5, None: [300] * 20, "é": [50] * 4}
    docs = documents(spark, sizes)
    rows = mix.taken(docs, block=16, shard_slots=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    order = ["a", "b", "c", "é", None]
    want = water_fill({s: sum(sizes[s]) for s in order}, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for s in order:
        assert {r.source_size for r in by[s]} == {sum(sizes[s])}
        assert by[s][0].target == pytest.approx(want[s])
        assert sum(r.taken for r in by[s]) == pytest.approx(want[s], rel=0.02, abs=16)
    assert listed(mix.taken(docs.repartition(7), block=16, shard_slots=64)) == listed(mix.taken(docs, block=16, shard_slots=64))


def test_mix_slots_are_whole_and_blocks_are_used_evenly(spark):
    docs = documents(spark, {"a": [333] * 20, "b": [77] * 10})
    placed, rows, plan = mix.mix(docs, block=32, shard_slots=50)
    slots = placed.select("shard", "slot", "rank", "pass", "block").distinct().collect()
    seen = defaultdict(list)
    for r in slots:
        seen[r.shard].append(r.slot)
    total = sum(map(len, seen.values()))
    assert total == sum(r.quota for r in plan.collect())
    for shard, at in seen.items():
        assert sorted(at) == list(range(min(50, total - 50 * shard)))
    # a pass over a source uses a block once at most, and all blocks before the next pass begins
    use = Counter((r.rank, r["pass"], r.block) for r in slots)
    assert set(use.values()) == {1}
    uses = defaultdict(Counter)
    for r in slots:
        uses[r.rank][r.block] += 1
    for c in uses.values():
        assert max(c.values()) - min(c.values()) <= 1 or min(c.values()) >= 1
    draws = Counter((r.shard, r.rank) for r in slots)
    assert len(set(draws.values())) > 2  # drawn, not dealt evenly


def test_blocks_of_the_mix_hold_the_streams(spark):
    docs = documents(spark, {"a": [333] * 20, "b": [77] * 10, None: [1, 5, 0, 64]})
    blocks, rows, plan = mix.mixed_blocks(docs, block=32, shard_slots=50)
    placed, _, _ = mix.mix(docs, block=32, shard_slots=50)
    got = blocks.collect()
    name = lambda r: (r.shard, r.slot, r.rank, r["pass"], r.block)
    assert Counter(map(name, got)) == Counter(map(name, placed.select("shard", "slot", "rank", "pass", "block").distinct().collect()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.rank: r for r in plan.collect()}
    streams = defaultdict(str)
    for r in sorted(rows.collect(), key=lambda r: (r.rank, r.granule, r.place)):
        streams[r.rank] += " " + texts[r.doc_id]
    for r in got:
        held = WORDS.findall(" ".join(p.words for p in r.parts))
        assert held == WORDS.findall(streams[r.rank])[32 * r.block:32 * r.block + 32]
        assert len(held) == 32 or r.block == sources[r.rank].blocks - 1
    words = Counter()
    for r in got:
        for p in r.parts:
            words[p.doc_id] += size(p.words)
            assert p.words in texts[p.doc_id]
    assert words == Counter({r.doc_id: r.taken for r in mix.taken(docs, block=32, shard_slots=50).collect() if r.taken})


def test_rows_that_share_an_id_are_spread(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    granules = mix.laid_out(docs.withColumn("source", F.lit("a")), 10).groupBy("granule").count().collect()
    assert len(granules) == 10 and max(r["count"] for r in granules) < 90


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark, {"a": [120] * 12, "b": [15] * 6, None: [40] * 3})
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mix.taken(docs, block=16).collect()}
    got = Counter()
    for r in mix.mixed_documents(docs, block=16).collect():
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
        words, whole = WORDS.findall(r.text), WORDS.findall(texts[r.doc_id])
        assert not Counter(words) - Counter(whole)
        if len(words) == len(whole):
            assert r.text == texts[r.doc_id]
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_mixed_documents_move_their_texts_once(spark):
    """One exchange above the scan that reads the texts; a granule's rows of several langs keep theirs."""
    docs = documents(spark, {"a": [120] * 12, "b": [15] * 6, None: [40] * 3})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mix.mixed_documents(docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string"))), block=16)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert all(r.lang == f"l{r.doc_id}" for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Scan" in line and "text#" in line)
    moves, near = 0, depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < near:
            near = depth[i]
            moves += "Exchange" in lines[i]
    assert moves == 1


def test_mix_edges(spark, edges, clashing, nothing):
    rows = mix.taken(edges).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted(
        (d is None, d or 0, size(t)) for d, t, *_ in edge_rows())
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert listed(mix.taken(clashing)) == listed(mix.taken(edges))
    assert mix.taken(nothing).count() == 0 and mix.mixed_documents(nothing).count() == 0
    assert mix.mixed_blocks(nothing)[0].count() == 0
    blank = edges.filter("doc_id <= 3")
    assert [(r.target, r.taken) for r in mix.taken(blank).collect()] == [(0.0, 0)] * 3
    assert mix.mixed_documents(clashing).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_native_plans_have_no_python(spark, edges):
    for df in (mix.taken(edges), mix.mixed_blocks(edges)[0], mix.mixed_documents(edges), shards.shuffled(edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in PYTHON)


def test_shards_are_exact_and_gapless(spark):
    docs = spark.range(1003).repartition(7).withColumnRenamed("id", "doc_id")
    rows = shards.shuffled(docs, shards=10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [100] * 7 + [101] * 3
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shard_counts_follow_the_hypergeometric_law(spark):
    """Means and variances of the matrix cells over many seeds."""
    parts = spark.createDataFrame([(0, 30, 0), (1, 50, 30), (2, 20, 80)], "part long, rows long, start long")
    cells = defaultdict(list)
    for seed in range(60):
        drawn = {(r.part, r.shard): r.n for r in shards.count_matrix(parts, 100, 4, seed).collect()}
        for p in range(3):
            for s in range(4):
                cells[p, s].append(drawn.get((p, s), 0))
        assert all(sum(drawn.get((p, s), 0) for p in range(3)) == 25 for s in range(4))
        assert [sum(drawn.get((p, s), 0) for s in range(4)) for p in range(3)] == [30, 50, 20]
    for (p, _), n in cells.items():
        k = (30, 50, 20)[p]
        mean, var = 25 * k / 100, 25 * (k / 100) * (1 - k / 100) * 75 / 99
        got = sum(n) / len(n)
        assert abs(got - mean) < 4 * (var / len(n)) ** 0.5
        assert 0.4 < sum((x - mean) ** 2 for x in n) / len(n) / var < 2


def test_shard_edges(spark, edges, clashing, nothing):
    rows = shards.shuffled(edges, shards=3).collect()
    key = lambda r: repr((r.doc_id, r.text, r.lang, r.source, r.n_chars))
    assert sorted(map(key, rows)) == sorted(map(key, edges.collect()))
    got = shards.shuffled(clashing, shards=3)
    assert got.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING if c not in ("shard", "slot"))
    assert shards.shuffled(nothing).count() == 0


def test_the_registered_query_shards_whole_documents(spark, edges, tmp_path, monkeypatch):
    """What reaches the operator, and the digests of what it returns."""
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    given, real = [], shards.shuffled
    monkeypatch.setattr(shards, "shuffled", lambda rows, *a, **b: given.append(rows) or real(rows, *a, **b))
    got = queries.op10_shards(spark, str(tmp_path)).collect()
    whole = lambda r: repr(tuple(r))
    assert sorted(map(whole, given[0].collect())) == sorted(map(whole, edges.collect()))
    text = [(r.doc_id, (r.text or "").encode()) for r in edges.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in text)


def test_counts_follow_inserts_deletes_and_revisions(spark, tmp_path):
    one, two = F.lit("words-1"), F.lit("split-2")
    ddl = "doc_id long, text string, lang string, source string"
    rolls = counts.Rollups(spark, str(tmp_path / "rolls"))
    first = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "s"), (3, None, None, None), (4, "x y z", "fr", "s")], ddl)
    assert rolls.apply(1, counts.counted(first, one))
    assert not rolls.apply(1, counts.counted(first, one))  # the same batch again changes nothing
    assert listed(rolls.totals()) == sorted([("s", "en", "words-1", 2, 3), (None, None, "words-1", 1, 0), ("s", "fr", "words-1", 1, 3)], key=repr)
    revised = spark.createDataFrame([(1, "a-b c", "en", "s"), (5, "q", "en", "t")], ddl)
    rolls.apply(2, counts.counted(revised, two), spark.createDataFrame([(4,), (99,)], "doc_id long"))
    want = sorted([("s", "en", "words-1", 1, 1), ("s", "en", "split-2", 1, 4), ("t", "en", "split-2", 1, 1), (None, None, "words-1", 1, 0)], key=repr)
    assert listed(rolls.totals()) == want
    # a batch that failed before its commit leaves files that nobody reads; its repeat replaces them
    counts.counted(first, one).select("source", "lang", "version", F.lit(7).alias("docs"), "tokens").write.parquet(str(tmp_path / "rolls/deltas/batch=3"))
    assert listed(rolls.totals()) == want
    rolls.apply(3, None, spark.createDataFrame([(1,), (5,), (2,), (3,)], "doc_id long"))
    assert rolls.totals().count() == 0 and rolls.ledger().count() == 0
    rolls.apply(4, counts.counted(first.limit(1), one), spark.createDataFrame([(1,)], "doc_id long"))
    assert listed(rolls.totals()) == [("s", "en", "words-1", 1, 2)]


def test_batches_in_any_order_of_their_numbers(spark):
    """Batches 1, 5, 3, 6 revise one document; a repeat of 3 changes nothing; totals and ledger agree after each."""
    rolls = counts.Rollups(spark)
    docs = lambda *texts: counts.counted(spark.createDataFrame([(i, t, "en", "s") for i, t in texts],
                                                               "doc_id long, text string, lang string, source string"), F.lit("words-1"))
    for number, text, tokens in ((1, "a", 1), (5, "a b c d", 4), (3, "a b c", 3), (6, "a b", 2), (3, "a b c d e", 2)):
        assert rolls.apply(number, docs((7, text))) == (tokens == len(text.split()))
        assert listed(rolls.totals()) == [("s", "en", "words-1", 1, tokens)]
        assert [r.tokens for r in rolls.ledger().collect()] == [tokens]
    rolls.apply(2, docs((None, "x y"), (None, "x y"), (None, None)), spark.createDataFrame([(None,), (7,)], "doc_id long"))
    assert listed(rolls.totals()) == [("s", "en", "words-1", 3, 4)] and rolls.ledger().count() == 0


def test_counts_edges(spark, edges, clashing, nothing):
    got = []
    for docs in (edges, clashing):
        rolls = counts.Rollups(spark)
        rolls.apply(1, counts.counted(docs, F.lit("words-1")))
        got.append(listed(rolls.totals()))
    want = Counter()
    docs_of = Counter()
    nameless = [r for r in edge_rows() if r[0] is None]  # each counts
    for d, t, lang, source, _ in [*{r[0]: r for r in edge_rows() if r[0] is not None}.values(), *nameless]:
        want[source, lang] += size(t)
        docs_of[source, lang] += 1
    assert got[0] == got[1] == sorted([(*k, "words-1", docs_of[k], want[k]) for k in docs_of], key=repr)
    rolls = counts.Rollups(spark)
    rolls.apply(1, counts.counted(nothing, F.lit("words-1")))
    assert rolls.totals().count() == 0
