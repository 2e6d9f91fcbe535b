"""Operators 11 to 13 against brute force and the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kontor.llm import align, periods, pieces, queries
from kontor.llm.words import text_slices

from .conftest import DDL, edge_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PIECE = public_tokenizers.path(queries.PIECE_TOKENIZER)
BYTE = public_tokenizers.path(queries.BYTE_TOKENIZER)
SHA = lambda raw: hashlib.sha256(raw).hexdigest()

#: Spaces in runs, space symbols, parts of characters, marks, special tokens' names, long words and repetitions.
ODD = ["", None, " ", "  a", "a  b ", "▁x", "a▁ b", "a ▁b", " ▁ ▁▁  a", "a\u0000b", "é\U0001f600 ab", "<|endoftext|> <s> </s> <0x41>",
       "ﬁ ½ 漢字", "\n\ta\r\n", " " * 100, "a" + " " * 47 + "b", "x" + " " * 31, "▁" * 40, "a" * 1000, "=" * 777, "abab" * 200, "이것은 한국어",
       "日本語 テキスト", "\U0001f600" * 50, "a  b　 c  d", "é é à ü", "x\x85 y \x1c z \x7f w", "don't 'll  's", "12 345 6", "a ́b c",
       "a Ȁ b ɐ߿ c", "﻿ a ​ b", "tail \n", " lead"]
TEXT = st.text(st.sampled_from("abeinrst  ▁é漢\U0001f600'=\n0") | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def table_of(spark, folder, rows):
    spark.createDataFrame(rows, DDL).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(texts):
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)]


# --- 11 ----------------------------------------------------------------------------------------

def naive_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - first + q >= max(12, 2 * q):
                found.setdefault((first - q, i - first + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def naive_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def search(texts):
    out = []
    for part in text_slices(pa.array(texts, pa.string()), 1 << 16):
        n, runs, kept = (c.to_pylist() for c in periods.Slice(part).columns())
        out += zip(n, [[(r["start"], r["length"], r["period"]) for r in x] for x in runs], kept, strict=True)
    return out


def grown(rng):
    """A text made of copies of its own parts: nested and neighbouring runs."""
    w = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
    while len(w) < rng.randint(20, 220):
        kind = rng.random()
        if kind < 0.4:
            w += w[-rng.randint(1, len(w)):] * rng.randint(1, 4)
        elif kind < 0.7:
            k = rng.randint(0, len(w) - 1)
            w += w[k: k + rng.randint(1, 30)]
        else:
            w += [rng.choice("abc") for _ in range(rng.randint(1, 3))]
    return " ".join(w[:260])


def test_runs_match_brute_force():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd"[:k]) for _ in range(rng.randint(0, 60))) for k in (2, 3, 4) for _ in range(400)]
    texts += [grown(rng) for _ in range(500)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), " ".join(("a" * 9 + "b") * 20), " ".join("".join("a" * i + "b" for i in range(25)))]
    texts += ["", None, " \n\t", "a", " ".join("a" * 11), " ".join("a" * 12), "\t" + "x y z " * 10 + "\n", "X x " * 20]
    for text, (n, runs, kept) in zip(texts, search(texts), strict=True):
        w = WORDS.findall(text or "")
        assert (n, runs) == (len(w), naive_runs(w)) and kept == naive_kept(w, runs)


def test_long_repetitions_open_few_diagonals(monkeypatch):
    """One word 100,000 times, a line 4,000 times, blocks of one word: not one diagonal for each pair of copies."""
    opened = []
    found = periods._matched
    monkeypatch.setattr(periods, "_matched", lambda *a: opened.append(1) or found(*a))
    line = "a b c d e f g a b c d e f h "
    texts = ["a " * 100_000, line * 4_000, ("a " * 1000 + "b ") * 20, "a " * 20_000 + "b " + "a " * 20_000]
    got = [r for _, r, _ in search(texts)]
    assert got[0] == [(0, 100_000, 1)] and got[1] == [(0, 56_000, 14)]
    assert got[2] == sorted([(0, 20_020, 1001)] + [(1001 * k, 1000, 1) for k in range(20)]) and len(got[3]) == 2
    assert len(opened) < 150_000


def test_windows_that_collide_are_compared():
    w = list("abcdefghijkl")
    assert periods.runs_of(np.arange(12), np.arange(5, 12), np.zeros(7, np.int64)) == naive_runs(w) == []
    w = list("abcabcabcabcx") * 2
    number = np.array([ord(c) for c in w])
    assert periods.runs_of(number, np.arange(5, 26), np.zeros(21, np.int64)) == naive_runs(w)


def test_op11_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [r[1] for r in edge_rows()] + [grown(rng) for _ in range(30)] + [prose(k, 40 + 5 * k) for k in range(60)]
    rows = [(i if i != 3 else None, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in queries.op11_periods(spark, table_of(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    periodic = 0
    for doc_id, text, *_ in rows:
        w = WORDS.findall(text or "")
        n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            periodic += 1
        runs = naive_runs(w) if n < 5000 else [r for r in search([" ".join(w)])[0][1]]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None, None, None)))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == SHA("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode())
        assert r.collapsed_sha256 == SHA(naive_kept(w, runs).encode())
    assert periodic > 5


# --- 12 ----------------------------------------------------------------------------------------

def coded(texts, limit=pieces.SLICE_BYTES):
    m, out = pieces.model(PIECE), []
    for part in text_slices(pa.array(texts, pa.string()), limit):
        ids, bounds = pieces.encoded(part, m, limit)
        decoded = m.decode(ids, bounds)
        out += [(ids[bounds[k]:bounds[k + 1]].tolist(), decoded[k].decode()) for k in range(part.n)]
    return out


def wanted(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def test_pieces_as_the_library(library):
    rng = random.Random(1)
    letters = ["abc ", " ▁a", "ab", "aeiourstnl ", "".join(map(chr, range(32, 127))), "éüñß漢字 ab\n\t", "0123456789 .", "===-/ "]
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in letters for _ in range(60)]
    own = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    joined = ["".join(rng.choice(own) for _ in range(rng.randint(0, 100))) for _ in range(200)]
    texts += joined + [t.replace(" ", "") for t in joined] + ["a" + " " * k + "b" for k in range(40)] + [" " * k for k in range(40)]
    assert coded(texts) == [wanted(library, t) for t in texts]
    word = "".join(joined).replace(" ", "")[:20000]
    long = "".join(joined) * 3 + word + " " * 5000 + "▁ x"
    for limit in (1000, 7777):  # parts of a long text; a word longer than a part
        assert coded([long, "a", long + " "], limit) == [wanted(library, t) for t in (long, "a", long + " ")]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_any_text_as_the_library(library, texts):
    assert coded(texts) == [wanted(library, t) for t in texts]


def test_ids_decode_as_the_library(library):
    """Any ids: stray bytes, control and unknown ids, pieces with spaces first."""
    rng = random.Random(2)
    some = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), 259 + rng.randrange(31741), 28705]) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    m = pieces.model(PIECE)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    got = m.decode(np.array([i for x in some for i in x], np.int64), bounds)
    assert [g.decode() for g in got] == [library.decode(x) for x in some]


def test_only_known_kinds_of_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as file:
        spec.ParseFromString(file.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="only BPE"):
        pieces.Model(str(tmp_path / "m"))


def test_op12_query(spark, library, edges, clashing, nothing, tmp_path):
    rows = rows_of(ODD + [r[1] for r in edge_rows()]) + [(None, "a null id", None, None, None), (1, "twice", None, None, None)]
    got = sorted(map(tuple, queries.op12_pieces(spark, table_of(spark, tmp_path, rows)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids, decoded = wanted(library, text)
        want.append((doc_id, len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA(decoded.encode())))
    assert got == sorted(want, key=repr)
    out = [sorted(map(tuple, pieces.encode_texts(d, PIECE).collect()), key=repr) for d in (edges, clashing)]
    assert out[0] == out[1] and pieces.decode_ids(pieces.encode_texts(nothing, PIECE), PIECE).count() == 0


# --- 13 ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens(library):
    """A function: (ids of A, ids of B, groups) of a text by whole encodings and decoded bytes alone; None without tokens."""
    own = align.aligner(BYTE, PIECE)
    a_bytes = lambda i: own.a_raw[own.a_bounds[i]:own.a_bounds[i + 1]].tobytes()

    def b_bytes(i):
        piece = library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()

    def read(text):
        if not text:
            return None
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
        raw_a, raw_b = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        groups, x, y = [], 0, 0
        place = [{end: k for k, end in enumerate(e)} for e in ends]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i, j = place[0][cut] + 1, place[1][cut] + 1
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        return a, b, groups
    return read


def summed(found):
    if found is None:
        return (0, 0, 0, 0, "")
    a, b, groups = found
    return (len(a), len(b), len(groups), sum(len(p) * len(q) for p, q in groups),
            ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups))


def links(found):
    return Counter((i, j) for p, q in (found[2] if found else []) for i in p for j in q)


def aligned(texts, own, limit=1 << 16):
    out = []
    for part in text_slices(pa.array(texts, pa.string()), limit):
        columns, pairs, _ = own.block(part)
        for k in range(part.n):
            at, weight = np.frombuffer(columns[5][k].as_py(), "<i4"), np.frombuffer(columns[6][k].as_py(), "<i8")
            pair = pairs[at].tolist()
            out.append((tuple(c[k].as_py() for c in columns[:5]),
                        Counter({(p >> align.BITS, p & ((1 << align.BITS) - 1)): w for p, w in zip(pair, weight.tolist(), strict=True)})))
    return out


def test_alignments_match_whole_encodings(tokens):
    rng = random.Random(1)
    letters = ["abc ", " ▁a", "aeiourstnl ", "".join(map(chr, range(32, 127))), "éüñß漢字 ab\n\t", "0123456789 .", "===-/ ", "é   ́ßa", "'sdtm la"]
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randint(0, 120))) for a in letters for _ in range(60)]
    texts += ["".join(chr(rng.choice([32, 32, rng.randint(0, 0x250), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 60)))
              for _ in range(300)]
    want = [(summed(f), links(f)) for f in map(tokens, texts)]
    assert aligned(texts, align.aligner(BYTE, PIECE)) == want
    whole = align.Aligner(BYTE, PIECE)
    whole.cuts = False  # the way of tokenizers whose cuts aren't known: whole texts
    assert aligned(texts, whole) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_any_text_is_aligned(tokens, texts):
    assert aligned(texts, align.aligner(BYTE, PIECE)) == [(summed(f), links(f)) for f in map(tokens, texts)]


def test_segments_are_forgotten(tokens, monkeypatch):
    monkeypatch.setattr(align, "KEPT_SEGMENTS", 20)
    texts = [prose(k, 30) for k in range(20)]
    assert aligned(texts, align.Aligner(BYTE, PIECE), 200) == [(summed(f), links(f)) for f in map(tokens, texts)]


def test_op13_query(spark, tokens, edges, clashing, nothing, tmp_path):
    rows = rows_of(ODD + [r[1] for r in edge_rows()] + [prose(k % 5, 60, 300) + f" é {k}" for k in range(30)]) + [(None, "a null id", None, None, None), (1, "twice", None, None, None)]
    found = [tokens(t) for _, t, *_ in rows]
    counts = Counter(pair for f in found for pair in links(f))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for (doc_id, *_), f in zip(rows, found, strict=True):
        of = links(f)
        *sums, groups = summed(f)
        want.append((doc_id, *sums, sum(n for p, n in of.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in of.items()),
                     SHA(groups.encode()) if f else ""))
    got = queries.op13_align(spark, table_of(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    blocks = align.aligned(docs, BYTE, PIECE, block_bytes=2000).drop("groups")  # many blocks hold the same pairs
    assert blocks.select("block").distinct().count() > 5
    assert sorted((tuple(r) for r in align.with_counts(blocks).collect()), key=repr) == sorted((w[:-1] for w in want), key=repr)
    out = [sorted(map(tuple, align.with_counts(align.aligned(d, BYTE, PIECE)).collect()), key=repr) for d in (edges, clashing)]
    assert out[0] == out[1] and align.with_counts(align.aligned(nothing, BYTE, PIECE)).count() == 0
