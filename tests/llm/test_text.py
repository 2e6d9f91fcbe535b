"""LM scoring, decontamination, Jaccard join, language ID: against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kontor.llm import decontaminate, jaccard, langid, lm
from kontor.llm.components import components
from kontor.llm.queries import id_remainder
from kontor.llm.words import per_text, shingles, text_slices
from tests.llm.conftest import WORDS, edge_rows, fold, listed, prose, words

DOCS = "doc_id long, text string"


def remainder(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


# --- words -------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [1, 5, 1 << 20])
def test_words_of_slices(limit):
    texts = ["", None, "  a B\tc ", "a b c", "ÀB x y z", "one two three four five six", " ", "one TWO three four five"]
    got, sets = [], []
    for part in text_slices(pa.array(texts), limit):
        start, end, text = part.words()
        hashes, bounds = part.hashes(start, end), per_text(text, part.n)
        runs, of = shingles(hashes, bounds, 5)
        for i in range(part.n):
            got.append([bytes(part.data[s:e]).decode() for s, e in zip(start[bounds[i]:bounds[i + 1]], end[bounds[i]:bounds[i + 1]], strict=True)])
            sets.append(runs[of == i].tolist())
    assert got == [WORDS.findall(t or "") for t in texts]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 2, 0, 1]
    assert sets[2] == sets[3] and sets[7][0] == sets[5][0]


# --- LM scoring --------------------------------------------------------------------------------

def brute_scores(rows, order):
    """Scores by the recursion of the model itself: no automaton, no arcs."""
    tokens = [words(t) + ["</s>"] for _, t in rows]
    grams = {k: Counter() for k in range(order)}  # by length of the context
    for (d, _), w in zip(rows, tokens, strict=True):
        if remainder(d, 5) != 1:
            padded = ["<s>", *w]
            for i in range(1, len(padded)):
                for k in range(min(order, i + 1)):
                    grams[k][tuple(padded[i - k:i + 1])] += 1
    context, kinds = Counter(), Counter()
    for k in range(1, order):
        for g, c in grams[k].items():
            context[g[:-1]] += c
            kinds[g[:-1]] += 1
    one = Counter({g[0]: c for g, c in grams[0].items()})
    n, v = sum(one.values()), len(one)
    disc = [lm.Weights.discount(sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())) for g in grams.values()]

    def p(u, w):
        if not u:
            return 1.0 if not n else (one[w] - disc[0]) / n if one[w] else disc[0] * v / n
        if not context[u]:
            return p(u[1:], w)
        d = disc[len(u)]
        return max(grams[len(u)][(*u, w)] - d, 0) / context[u] + d * kinds[u] / context[u] * p(u[1:], w)

    out = []
    for (d, _), w in zip(rows, tokens, strict=True):
        padded = ["<s>", *w]
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1):i]), padded[i])) for i in range(1, len(padded)))
        out.append((d, remainder(d, 5) == 1, len(w), sum(one[x] > 0 for x in w), n,
                    sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), score))
    vocabulary = [*one, "<unk>"]
    for u in [("<s>",), *list(context)[:5], *list(context)[-5:], ("never",)]:
        assert sum(p(u, w) for w in vocabulary) == pytest.approx(1)
    return out


def check_scores(df, rows, order=2):
    got = sorted(map(tuple, lm.score_texts(df, id_remainder(5) != 1, order).collect()), key=repr)
    for g, w in zip(got, sorted(brute_scores(rows, order), key=repr), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_match_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lm, "LANE", 7)
    rows = [(i, prose(i % 37, 5 + i % 90, 60)) for i in range(120)] + [(None, "w1 w2"), (500, None), (501, ""), (502, "W1 new w2")]
    check_scores(spark.createDataFrame(rows, DOCS).repartition(5), rows, order)


def test_lm_edges(spark, edges, clashing, nothing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check_scores(edges, rows)
    check_scores(clashing, rows, 3)
    assert lm.score_texts(nothing, id_remainder(5) != 1).count() == 0
    untrained = lm.score_texts(edges, F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.score == 0 for r in untrained)


# --- decontamination ---------------------------------------------------------------------------

def brute_tiles(doc, item, least):
    """Greedy string tiling as it is defined: look for the longest unmarked match again and again."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and free_d[d + k] and free_i[i + k]:
                    k += 1
                if k >= least and (best is None or (-k, d, i) < best):
                    best = (-k, d, i)
        if best is None:
            return sorted(tiles)
        k, d, i = -best[0], best[1], best[2]
        tiles.append((d, i, k))
        free_d[d: d + k] = [False] * k
        free_i[i: i + k] = [False] * k


def test_tiles_match_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randrange(3, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(3, 60))]
        seeds = decontaminate.Seeds([" ".join(item)], 3)
        part = next(text_slices(pa.array([" ".join(doc)])))
        start, end, text = part.words()
        tiles = []
        for _, _, d, i, width in seeds.hits(part.hashes(start, end), per_text(text, 1)):
            tiles = decontaminate.tile(decontaminate.maximal_matches(d, i, width), width, len(item))
        assert tiles == brute_tiles(doc, item, 3)


def test_reordered_and_edited_passages_are_found(spark):
    item = prose(7, 40).split()
    cut = item[20:] + prose(8, 30).split() + item[:20]
    docs = [(1, prose(9, 100) + " " + " ".join(item) + " " + prose(10, 50)), (2, " ".join(cut)), (3, prose(11, 300)),
            (4, ", ".join(w.upper() for w in item) + "!"), (5, " ".join(item[:10]) + " " + prose(12, 80)), (6, None), (7, ""),
            (None, " ".join(item)), (8, "w1 w2"), (9, " ".join(item)), (9, " ".join(item))]
    bench = [(1, " ".join(item)), (2, None), (3, ""), (4, "w1 w2"), (5, " ".join(item[:10]))]
    frames = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("own")), spark.createDataFrame(bench, "item_id long, text string")
    for blocks in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.contaminated(*frames, block_bytes=blocks).collect()
        pairs = Counter((r.doc_id, r.item_id) for r in got)
        assert pairs == Counter({(1, 1): 1, (1, 5): 1, (2, 1): 1, (2, 5): 1, (4, 1): 1, (4, 5): 1, (5, 5): 1, (None, 1): 1, (None, 5): 1,
                                 (8, 4): 1, (9, 1): 2, (9, 5): 2})
        two = next(r for r in got if (r.doc_id, r.item_id) == (2, 1))
        assert two.coverage == 1 and len(two.tiles) == 2 and [t.words for t in two.tiles] == [20, 20]
    assert decontaminate.contaminated(frames[0], frames[1].limit(0)).count() == 0


def test_long_passage_of_a_long_item_is_found(spark):
    item = prose(21, 500).split()
    at = 120
    docs = [(1, prose(22, 200) + " " + " ".join(item[at:at + 150]) + " " + prose(23, 90)), (2, " ".join(item[:50])),
            (3, " ".join(item[:49])), (4, " ".join(item[30:70] + ["zq"] + item[200:240]))]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(*frames).collect()}
    assert sorted(got) == [1, 2]  # 150 words and just 50 in a row; 49, or two of 40, are no passage
    assert got[1].coverage < decontaminate.COVERAGE and max(t.words for t in got[1].tiles) >= 150
    assert any(t.item_word <= at and t.item_word + t.words >= at + 150 for t in got[1].tiles)


def test_decontamination_edges(spark, edges, clashing, nothing):
    bench = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")
    want = sorted([6, 6, 7, 8, -1, 9])
    for docs in (edges, clashing):
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in decontaminate.contaminated(docs, bench).collect()) == want
    assert decontaminate.contaminated(nothing, bench).count() == 0


# --- Jaccard join ------------------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in inverted[x])
        for j, both in near.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return sorted(((d, len(sets[i]), d if not sets[i] else min(low[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k: k + 1] = rng.choice([["new%d" % rng.randrange(10 ** 6)], [], [w[k], "more%d" % rng.randrange(10 ** 6)]])
    return " ".join(w)


def crowd(seed):
    """Unrelated texts, chains of edits, copies, a shared passage, sizes from one word to 1500."""
    rng = random.Random(seed)
    texts = [prose(1000 + i, rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 200])) for i in range(60)]
    passage = prose(5000, 60)
    texts += [prose(2000 + i, rng.choice([5, 20, 80])) + " " + passage for i in range(40)]
    for n in (8, 30, 100, 400, 1010, 1500):
        base = prose(3000 + n, n)
        for _ in range(8):
            texts += [base, edited(base, rng, max(1, n // rng.choice([18, 22, 30, 60])))]
            if rng.random() < 0.4:
                base = texts[-1]
    base = prose(7000, 120)
    texts += [edited(base, rng, rng.choice([1, 2, 3, 5, 8])) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[70], (None, texts[5]), (None, "only here"), (None, None)]


@pytest.mark.parametrize("group", [1, 6, 64])
def test_components_match_brute_force(spark, group):
    """With small group limits the unsettled and crowd routes carry the links."""
    rows = crowd(group)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), group)
    assert listed(got) == brute_components(rows)


def test_sketch_keys_keep_their_promise():
    """A linked pair shares at least one key more than the slack it is promised."""
    rng = random.Random(3)
    for n in (40, 300, 1000, 1400, 2500, 5000):
        a = prose(n, n, 10 ** 6)
        b = edited(a, rng, n // 45)
        parts = [next(text_slices(pa.array([t]), 1 << 30)) for t in (a, b)]
        sets = [jaccard.Sets(p) for p in parts]
        (ka, _, na), (kb, _, nb) = (jaccard._first_keys(s) for s in sets)
        x, y = (set(s.items.tolist()) for s in sets)
        assert len(x & y) >= 0.75 * len(x | y)
        assert len(set(ka.tolist()) & set(kb.tolist())) >= 1 + min(na[0], nb[0]) // 16


def test_component_rounds(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (50, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)}


def test_jaccard_edges(spark, edges, clashing, nothing):
    want = brute_components([(r[0], r[1]) for r in edge_rows()])
    assert listed(jaccard.near_duplicates(edges)) == want
    assert listed(jaccard.near_duplicates(clashing)) == want
    assert jaccard.near_duplicates(nothing).count() == 0


# --- language ID -------------------------------------------------------------------------------

def brute_phrases(sample: bytes, text: bytes) -> int:
    at = n = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at: at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_match_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        sample = langid.folded(next(text_slices(pa.array(["".join(rng.choice("abc ") for _ in range(80))]))))[0].tobytes()
        model = langid.Model({"x": sample})
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 300)))
        part = next(text_slices(pa.array([text])))
        data = langid.folded(part)[0].tobytes()
        cost = model.costs(part)[0, 0]
        want = brute_phrases(sample, data)
        assert cost * len(data) == pytest.approx(want * model.languages[0].bits)


def test_languages_are_told_apart(spark):
    def text(seed, syllables):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(60)).capitalize()

    sets = {"en": ["the", "ing", "ow"], "fr": ["que", "oi", "é"], "de": ["sch", "ung", "ü"]}
    rows = [(i, text(i, sets[lang]), lang) for i, lang in enumerate(sorted(sets) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, id_remainder(4) != 2)
    got = langid.predict(docs.withColumn("lang", F.lit("zz")), model, F.col("doc_id")).collect()
    truth = {d: lang for d, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 118
    assert all(0 <= r.score <= 1 for r in got)


def test_shares_of_the_sample(spark):
    """Each picked text gives the same share, a long one pieces from start to end."""
    texts = ["", "short text", "a" * 40_000 + "b" * 40_000, "é" * 5_000, "x" * 513]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(langid.shared_part("text", F.lit(512.0)).alias("part")).collect()
    parts = [r.part for r in got]
    assert parts[:2] == texts[:2]
    assert parts[2] == " ".join([c * langid.PIECE for c in "aabb"])
    assert parts[3] == " ".join(["é" * langid.PIECE] * 2) and len(parts[3].encode()) <= 514
    assert len(parts[4]) == 4 * langid.PIECE + 3
    long = [(i, ("the cat sat " if i else "un deux trois ") * (30 if i else 200_000), "en" if i else "fr") for i in range(9)]
    model = langid.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"), F.lit(True))
    assert [x.name for x in model.languages] == ["en", "fr"]
    assert all(x.table.size // x.width < 3 * langid.SAMPLE_BYTES for x in model.languages)


def test_language_edges(spark, edges, clashing, nothing):
    model = langid.fit(edges, F.lit(True))
    first = listed(langid.predict(edges, model, F.col("doc_id")))
    assert first == listed(langid.predict(clashing, model, F.col("doc_id")))
    by = defaultdict(list)
    for d, pred, score in first:
        by[d].append((pred, score))
    assert all(by[d] == [("und", 0.0)] for d in (1, 2, 3, 10)) and sorted(by[None])[1] == ("und", 0.0)
    assert by[5][0][0] == "en" and by[11][0][0] == "es" and len(by[6]) == 2
    assert langid.predict(nothing, model, F.col("doc_id")).count() == 0
    unlabelled = langid.fit(edges, F.lit(False))
    assert {r.lang_pred for r in langid.predict(edges, unlabelled, F.col("doc_id")).collect()} == {"und"}


def test_folding():
    part = next(text_slices(pa.array(["ÉTÉ 12, Straße", "a  b", ""]), 1 << 20))
    data, bounds = langid.folded(part)
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["été straße", "a b", ""]
    assert fold("ÉA") == "Éa"
