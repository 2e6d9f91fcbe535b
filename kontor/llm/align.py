"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE of the tokenizers library, read on a space and the text; B a sentencepiece BPE, which puts
the space there itself. Coarse cuts are the libraries' own spans: character offsets of A, the spans of sentencepiece's
proto of B. Tokens that end inside a character (parts of a multibyte character in A, byte-fallback tokens in B) are refined by
the bytes they decode to, counted from the last cut. Byte offsets where tokens of both end cut them into groups, and
all A-B pairs of occurrences in a group are linked.

Both tokenizers cut before a single space between two plain characters (checked when they are loaded; else a text is
one segment), so texts are read as segments cut there. Distinct segments are encoded once while they
are kept, many in one call; equal ids of a group are counted, not paired one by one.

`aligned` gives one row per document and numbers its id pairs within a block of documents. `with_counts` counts, for each
pair, the documents that hold it: blocks ask for their pairs once, Spark joins the counts, and each block's
documents meet its answers. So what is shuffled is a block's distinct pairs, and no table of all pairs is held anywhere.

Defined cases: a text that is null, empty, or that one of the tokenizers does not give back byte for byte (B turns U+2581 into a
space) has no tokens: zeros and empty `groups`; repeated rows count as documents of their own; a long text is aligned whole;
an empty table gives no rows; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.ids import _byte_characters
from kontor.llm.pieces import gathered, model
from kontor.llm.scratch import stored
from kontor.llm.words import Texts, text_slices

BLOCK_BYTES = 2 << 20
CALL_LENGTH = 32 << 10
KEPT_SEGMENTS = 300_000
KEPT_PAIRS = 4_000_000
BITS = 17  # of an id in a pair's number

#: A single space between these bytes is a cut: printable ASCII, and characters of two bytes from 0xC3 on.
PLAIN = np.zeros(256, bool)
PLAIN[0x21:0x7F] = True
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xE0] = True


def pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << BITS) | b


class Flat:
    """A growing array."""

    def __init__(self, dtype: type):
        self.data, self.size = np.zeros(1 << 16, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        while self.size + values.size > self.data.size:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size: self.size + values.size] = values
        self.size += values.size


class Aligner:
    """Alignments of distinct segments, kept for later texts."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = Tokenizer.from_file(a_path), model(b_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        with open(a_path, encoding="utf-8") as file:
            parts = json.load(file)
        cutter = parts["pre_tokenizer"] or {}
        if cutter.get("type") != "ByteLevel" or parts["normalizer"]:
            raise ValueError(f"{a_path}: A must be a byte-level tokenizer without a normaliser")
        self.cuts = cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not self.b.spaced
        size = max(self.a.get_vocab().values()) + 1
        if max(size, self.b.size) >> BITS:
            raise ValueError("a vocabulary is too large for pair numbers")
        byte_of = {c: b for b, c in _byte_characters().items()}
        raw = [b""] * size
        for token, i in self.a.get_vocab().items():
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.a_raw, self.a_bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.names = [str(i) for i in range(max(size, self.b.size))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pairs, self.weights, self.bounds = Flat(np.int64), Flat(np.int64), Flat(np.int64)
        self.counts = [Flat(np.int64) for _ in range(4)]  # n_a, n_b, n_groups, n_links
        self.good, self.groups = Flat(bool), []
        self.bounds.extend(np.zeros(1, np.int64))

    # --- segments ----------------------------------------------------------------------------

    def _starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        start = np.zeros(data.size, bool)
        start[first] = True
        if self.cuts and data.size > 3:
            after = PLAIN[data] | LEAD[data]  # a byte that may follow the cut's space
            before = PLAIN[data]
            before[1:] |= LEAD[data[:-1]] & (data[1:] >= 0x80)
            start[1:-1] |= (data[1:-1] == 0x20) & before[:-2] & after[2:]
        return np.flatnonzero(start)

    def _ends(self, coarse: np.ndarray, inside: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: the library's, refined by decoded bytes where a token ends `inside` a character."""
        if not inside.any():
            return coarse
        total = np.cumsum(lens)
        anchor = np.maximum.accumulate(np.where(inside, -1, np.arange(coarse.size)))
        base = np.where(anchor >= 0, coarse[anchor] - total[anchor], 0)
        return base + total

    def _read_a(self, text: str, byte_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = self.a.encode(text, add_special_tokens=False)
        ids = np.array(code.ids, np.int64)
        spans = np.fromiter(itertools.chain.from_iterable(code.offsets), np.int64, 2 * ids.size).reshape(-1, 2)
        inside = np.zeros(ids.size, bool)
        inside[:-1] = spans[1:, 0] < spans[:-1, 1]
        lens = np.diff(self.a_bounds)[ids]
        return ids, self._ends(byte_at[spans[:, 1]], inside, lens), self.a_raw[gathered(self.a_bounds[:-1][ids], lens)]

    def _read_b(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text starts with the space that the library adds."""
        flat = [x for p in self.b.library.encode(text[1:], return_type="proto").pieces for x in (p.id, p.begin, p.end)]
        ids, begin, end = np.array(flat, np.int64).reshape(-1, 3).T
        inside = np.zeros(ids.size, bool)
        # byte tokens: all but a character's last have empty spans
        inside[:-1] = self.b.is_byte[ids[:-1]] & (begin[:-1] == end[:-1])
        lens = np.diff(self.b.raw_bounds)[ids]
        return ids, self._ends(end + 1, inside, lens), self.b.raw[gathered(self.b.raw_bounds[:-1][ids], lens)]

    @staticmethod
    def _kept(ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, lens: np.ndarray, data: np.ndarray, edge: np.ndarray) -> tuple:
        """Each token's segment, and which segments' tokens join to their bytes."""
        segment = np.searchsorted(edge[1:], ends)
        sizes = np.diff(edge)
        good = np.bincount(segment, weights=lens, minlength=sizes.size).astype(np.int64) == sizes
        own, mine = np.repeat(good[segment], lens), np.repeat(good, sizes)
        differs = raw[own] != data[mine]
        if differs.any():
            good[np.repeat(np.arange(sizes.size), sizes)[mine][differs]] = False
        return segment, good

    def _learn(self, segments: list[str]) -> None:
        """Align segments that are not kept yet: those that end in a plain character many in one call, as a cut
        may follow them; others (a text's end) alone."""
        many, size = [], 0
        for s in segments:
            if not self.cuts or not ("!" <= s[-1] <= "~" or "\xc0" <= s[-1] <= "\u07ff"):
                self._align([s])
                continue
            many.append(s)
            size += len(s)
            if size >= CALL_LENGTH:
                self._align(many)
                many, size = [], 0
        if many:
            self._align(many)

    def _align(self, segments: list[str]) -> None:
        text = "".join(segments)
        data = np.frombuffer(text.encode(), np.uint8)
        if data.size == len(text):
            byte_at, edge = np.arange(data.size + 1), np.cumsum([0, *map(len, segments)])
        else:
            byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), data.size)
            edge = byte_at[np.cumsum([0, *map(len, segments)])]
        a, a_end, a_raw = self._read_a(text, byte_at)
        b, b_end, b_raw = self._read_b(text)
        a_in, a_good = self._kept(a, a_end, a_raw, np.diff(self.a_bounds)[a], data, edge)
        b_in, b_good = self._kept(b, b_end, b_raw, np.diff(self.b.raw_bounds)[b], data, edge)
        good = a_good & b_good
        n = len(segments)
        (a, a_end, a_in), (b, b_end, b_in) = [tuple(x[good[s]] for x in (i, e, s)) for i, e, s in ((a, a_end, a_in), (b, b_end, b_in))]
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
        group_in = np.searchsorted(edge[1:], cut)
        a_size, b_size = np.bincount(a_group, minlength=cut.size), np.bincount(b_group, minlength=cut.size)
        links = np.bincount(group_in, weights=a_size * b_size, minlength=n).astype(np.int64)
        for flat, values in zip(self.counts, (np.bincount(a_in, minlength=n), np.bincount(b_in, minlength=n),
                                              np.bincount(group_in, minlength=n), links), strict=True):
            flat.extend(values)
        self.good.extend(good)
        self._link(a, a_group, b, b_group, group_in, n)
        self._name(a, a_size, b, b_size, group_in, n)
        first = len(self.number)
        self.number.update(zip(segments, range(first, first + n), strict=True))

    def _link(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, group_in: np.ndarray, n: int) -> None:
        """Distinct id pairs of each segment with their numbers of links: distinct ids of a group, by their counts."""
        left, many_left = np.unique((a_group << BITS) | a, return_counts=True)
        right, many_right = np.unique((b_group << BITS) | b, return_counts=True)
        mask = (1 << BITS) - 1
        per_group = np.bincount(right >> BITS, minlength=group_in.size)
        opening = np.cumsum(per_group) - per_group
        lens = per_group[left >> BITS]
        with_b = gathered(opening[left >> BITS], lens)
        key = (np.repeat(group_in[left >> BITS], lens) << (2 * BITS)) | pair_number(np.repeat(left & mask, lens), right[with_b] & mask)
        distinct, use = np.unique(key, return_inverse=True)
        weight = np.bincount(use, weights=np.repeat(many_left, lens) * many_right[with_b], minlength=distinct.size).astype(np.int64)
        self.bounds.extend(self.pairs.size + np.searchsorted(distinct >> (2 * BITS), np.arange(1, n + 1)))
        self.pairs.extend(distinct & ((1 << 2 * BITS) - 1))
        self.weights.extend(weight)

    def _name(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, group_in: np.ndarray, n: int) -> None:
        """Groups of each segment as text."""
        left, right = [self.names[i] for i in a.tolist()], [self.names[i] for i in b.tolist()]
        texts, x, y = [], 0, 0
        for p, q in zip(a_size.tolist(), b_size.tolist(), strict=True):
            texts.append((left[x] if p == 1 else ",".join(left[x: x + p])) + "|" + (right[y] if q == 1 else ",".join(right[y: y + q])))
            x, y = x + p, y + q
        edge = np.searchsorted(group_in, np.arange(n + 1)).tolist()
        self.groups += [texts[i] if j - i == 1 else ";".join(texts[i:j]) for i, j in itertools.pairwise(edge)]

    # --- documents ---------------------------------------------------------------------------

    def read(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kept numbers of all segments of the texts, their bounds (n + 1), and which texts have tokens."""
        if len(self.number) > KEPT_SEGMENTS or self.pairs.size > KEPT_PAIRS:
            self.forget()
        full = np.diff(texts.offsets) > 0
        if not full.any():
            return np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64), full
        data = np.insert(texts.data, texts.offsets[:-1][full], 0x20)
        offsets = texts.offsets + np.concatenate([[0], np.cumsum(full)])
        starts = self._starts(data, offsets[:-1][full])
        cuts = pa.py_buffer(np.append(starts, data.size).astype(np.int64).tobytes())
        coded = pa.Array.from_buffers(pa.large_utf8(), starts.size, [None, cuts, pa.py_buffer(data.tobytes())]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        self._learn([s for s in names if s not in self.number])
        use = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        bounds = np.searchsorted(starts, offsets)
        bad = np.concatenate([[0], np.cumsum(~self.good.data[use])])[bounds]
        ok = full & (np.diff(bad) == 0)
        sizes = np.where(ok, np.diff(bounds), 0)
        return use[np.repeat(ok, np.diff(bounds))], np.concatenate([[0], np.cumsum(sizes)]), ok

    def block(self, texts: Texts) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups, link_pair, link_weight of every text; the block's pairs and
        how many of its texts hold each."""
        use, bounds, ok = self.read(texts)
        sums = [np.concatenate([[0], np.cumsum(flat.data[use])])[bounds] for flat in self.counts]
        numbers = use.tolist()
        groups = [";".join([self.groups[i] for i in numbers[x:y]]) for x, y in itertools.pairwise(bounds.tolist())]
        # a text's segments counted once each, then their pairs
        text = np.repeat(np.arange(texts.n), np.diff(bounds))
        seen, times = np.unique(text * len(self.number) + use, return_counts=True)
        text, use = np.divmod(seen, max(len(self.number), 1))
        lens = self.bounds.data[use + 1] - self.bounds.data[use]
        at = gathered(self.bounds.data[use], lens)
        pairs, number = np.unique(self.pairs.data[at], return_inverse=True)
        entry, same = np.unique(np.repeat(text, lens) * max(pairs.size, 1) + number, return_inverse=True)
        weight = np.bincount(same, weights=self.weights.data[at] * np.repeat(times, lens), minlength=entry.size).astype(np.int64)
        text, number = np.divmod(entry, max(pairs.size, 1))
        edge = np.searchsorted(text, np.arange(texts.n + 1))
        columns = [pa.array(np.diff(s)) for s in sums] + [pa.array(groups, pa.string()), _packed(number.astype("<i4"), edge), _packed(weight, edge)]
        return columns, pairs, np.bincount(number, minlength=pairs.size)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    cuts = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(values.tobytes())])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


#: Columns that connect a document's links with the pairs of its block.
LINKS = ["block", "link_pair", "link_weight", "block_pairs", "block_docs"]


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",),
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, ids of A and B in order) and the LINKS columns:
    link_pair (32-bit numbers in block_pairs) and link_weight (64-bit numbers of links) of the document's distinct id pairs;
    block_pairs (64-bit pair numbers, ascending) and block_docs (64-bit, how many of the block's documents hold each) are in
    a block's first row only."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for texts in text_slices(batch.column(len(keep)), block_bytes):
                columns, pairs, docs_of = aligner(a_path, b_path).block(texts)
                own = batch.slice(texts.first, texts.n)
                once = [pa.array([x.astype("<i8").tobytes()] + [None] * (texts.n - 1), pa.binary()) for x in (pairs, docs_of)]
                yield pa.RecordBatch.from_arrays([*own.columns[:len(keep)], *columns[:5], pa.array(np.full(texts.n, block)), *columns[5:], *once],
                                                 names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups", *LINKS])
                block += 1

    rows = docs.select(*keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(align, f"{kept}, n_a long, n_b long, n_groups long, n_links long, groups string, block long, "
                                  "link_pair binary, link_weight binary, block_pairs binary, block_docs binary")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, pair, docs: one row for each distinct pair of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = np.frombuffer(batch.column(1)[i].as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.size, batch.column(0)[i].as_py())), pa.array(pairs),
                                              pa.array(np.frombuffer(batch.column(2)[i].as_py(), "<i8"))], names=["block", "pair", "docs"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, docs and best (no pair of that A id is in more documents), over all blocks of (stored) aligned rows."""
    asked = rows.filter("block_pairs IS NOT NULL").select("block", "block_pairs", "block_docs").mapInArrow(_listed, "block long, pair long, docs long")
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("docs"))
    a = F.shiftright("pair", BITS).cast("int")
    # one row for each id of A's vocabulary at most
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("_top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select(
        "pair", "a", F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "docs", (F.col("docs") == F.col("_top")).alias("best"))


def with_counts(rows: DataFrame) -> DataFrame:
    """Aligned rows without the LINKS columns, with n_best (links whose pair is `best`) and count_sum (documents of the
    pair, summed over links)."""
    rows = stored(rows, "aligned")
    counts = stored(pair_counts(rows).select("pair", "docs", "best"), "aligned-counts")
    asked = rows.filter("block_pairs IS NOT NULL").select("block", "block_pairs", "block_docs").mapInArrow(_listed, "block long, pair long, docs long")
    answers = asked.select("block", "pair").join(counts, "pair").select("block", "pair", "docs", "best")
    kept = [c for c in rows.columns if c not in LINKS]

    def answered(mine: pa.Table, told: pa.Table) -> pa.Table:
        """The documents of one block (bounded by the block's bytes and one text) and the counts of its pairs."""
        order = np.argsort(told.column("pair").to_numpy())
        docs = told.column("docs").to_numpy()[order]
        best = told.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for pairs, weights in zip(mine.column("link_pair"), mine.column("link_weight"), strict=True):
            at, weight = np.frombuffer(pairs.as_py(), "<i4"), np.frombuffer(weights.as_py(), "<i8")
            n_best.append(int(weight[best[at]].sum()))
            count_sum.append(int((weight * docs[at]).sum()))
        return pa.table([*[mine.column(c) for c in kept], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                        names=[*kept, "n_best", "count_sum"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return (rows.drop("block_pairs", "block_docs").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(answered, f"{own}, n_best long, count_sum long"))
