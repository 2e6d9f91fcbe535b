"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH words that a document shares with a benchmark item, found by their
Karp-Rabin hashes. For every pair of document and item with a seed, maximal matches are
marked longest first, each word of either side at most once, until none of MIN_MATCH words is
left; the marked share of the item's words is its coverage. Tiles may lie anywhere
in the document, so passages in another order are found as well. A pair is reported from a coverage of
COVERAGE on, or from one tile of PASSAGE words on: a long verbatim passage of a long item is a leak whatever
its share.

Words are runs of letters and digits (bytes of other scripts included), A-Z as a-z, so
punctuation and case don't hide a passage.

The benchmark comes in blocks of about BLOCK_BYTES of text, one scan of the documents per
block, so what a task holds does not grow with the benchmark.

Defined cases: null or empty texts match nothing, in documents and items alike; an item of fewer words
than MIN_MATCH is matched as a whole; repeated documents or items give rows each; an empty benchmark or
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.words import ALNUM, U64, mix64, per_text, shingles, text_slices

MIN_MATCH = 5
COVERAGE = 0.4
PASSAGE = 50
BLOCK_BYTES = 8 << 20

PAIRS = ("doc_id long, item_id long, item_words int, covered int, coverage double, "
         "tiles array<struct<doc_word: int, item_word: int, words: int>>")
_TILES = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))


class Seeds:
    """All seeds of a block of benchmark items, by seed width: sorted hashes with item and position."""

    BITS = 22

    def __init__(self, texts: list[str | None], min_match: int):
        self.lengths = np.zeros(len(texts), np.int64)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for part in text_slices(pa.array(texts, pa.string())):
            start, end, text = part.words(ALNUM)
            hashes, bounds = part.hashes(start, end), per_text(text, part.n)
            lens = np.diff(bounds)
            self.lengths[part.first: part.first + part.n] = lens
            for width in np.unique(np.minimum(lens[lens > 0], min_match)).tolist():
                runs, of = shingles(hashes, bounds, width)
                first = np.searchsorted(of, np.arange(part.n))
                fits = (lens == width)[of] if width < min_match else (lens >= width)[of]
                position = np.arange(of.size) - first[of]
                found.setdefault(width, []).append((runs[fits], (of + part.first)[fits], position[fits]))
        self.by_width = {}
        for width, parts in found.items():
            runs, item, position = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((position, item, runs))
            filter_ = np.zeros(1 << self.BITS, bool)
            filter_[runs & U64((1 << self.BITS) - 1)] = True
            self.by_width[width] = (runs[order], item[order], position[order], filter_)

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, item, word in text, word in item of every shared seed, with the seed's width."""
        lens = np.diff(bounds)
        for width, (known, item, position, filter_) in self.by_width.items():
            runs, of = shingles(hashes, bounds, width)
            at = np.flatnonzero(filter_[runs & U64((1 << self.BITS) - 1)])
            at = at[(lens >= width)[of[at]]]
            low = np.searchsorted(known, runs[at], "left")
            n = np.searchsorted(known, runs[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            each = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.searchsorted(of, np.arange(bounds.size - 1))
            text = np.repeat(of[at], n)
            yield text, item[each], np.repeat(at - first[of[at]], n), position[each], width


def maximal_matches(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(length, word in document, word in item) of the maximal runs of seeds along diagonals."""
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order], item[order]
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] - item[1:] != doc[:-1] - item[:-1]) | (doc[1:] != doc[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [doc.size]])) + width - 1
    return list(zip(length.tolist(), doc[begin].tolist(), item[begin].tolist(), strict=True))


def tile(matches: list[tuple[int, int, int]], width: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (word in document, word in item, length): always the longest match whose words are
    all free, ties to the earlier place in the document, then in the item. A match that has lost words to a longer tile goes back with what is left."""
    heap = [(-n, d, i) for n, d, i in matches]
    heapq.heapify(heap)
    doc_taken: set[int] = set()
    item_free = np.ones(item_words, bool)
    left, tiles = item_words, []
    while heap and left >= width:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = item_free[i: i + n].copy()
        for k in np.flatnonzero(free).tolist():
            free[k] = d + k not in doc_taken
        if free.all():
            item_free[i: i + n] = False
            doc_taken.update(range(d, d + n))
            left -= n
            tiles.append((d, i, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return sorted(tiles)


def _tiling(seeds: Seeds, item_ids: list, coverage: float, passage: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                start, end, text = part.words(ALNUM)
                bounds = per_text(text, part.n)
                rows = []
                for of, item, d, i, width in seeds.hits(part.hashes(start, end), bounds):
                    if not of.size:
                        continue
                    order = np.lexsort((item, of))
                    of, item, d, i = of[order], item[order], d[order], i[order]
                    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])]))
                    for a, b in zip(cut, [*cut[1:], of.size], strict=True):
                        words = int(seeds.lengths[item[a]])
                        # words under any seed bound the coverage from above
                        under = np.unique((i[a:b, None] + np.arange(width)).ravel()).size
                        if under < min(coverage * words, passage):
                            continue
                        tiles = tile(maximal_matches(d[a:b], i[a:b], width), width, words)
                        covered = sum(n for _, _, n in tiles)
                        if covered >= coverage * words or max((n for _, _, n in tiles), default=0) >= passage:
                            rows.append((part.first + int(of[a]), int(item[a]), words, covered, tiles))
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0).take(pa.array([r[0] for r in rows])),
                        "item_id": pa.array([item_ids[r[1]] for r in rows], pa.int64()),
                        "item_words": pa.array([r[2] for r in rows], pa.int32()),
                        "covered": pa.array([r[3] for r in rows], pa.int32()),
                        "coverage": pa.array([r[3] / r[2] for r in rows], pa.float64()),
                        "tiles": pa.array([[dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in r[4]] for r in rows], _TILES)})
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                 block_bytes: int = BLOCK_BYTES, passage: int = PASSAGE) -> DataFrame:
    """Pairs of document and benchmark item of which at least `coverage` is tiled, or `passage` words in one tile, with the tiles."""
    spark = docs.sparkSession
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in range(blocks):
        rows = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
                .orderBy("item_id", "text").collect())
        if not rows:
            continue
        seeds = Seeds([r.text for r in rows], min_match)
        pairs = texts.mapInArrow(_tiling(seeds, [r.item_id for r in rows], coverage, passage), PAIRS)
        out = pairs if out is None else out.unionByName(pairs)
    return spark.createDataFrame([], PAIRS) if out is None else out
