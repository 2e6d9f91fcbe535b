"""Periodic runs of words: an online sparse dynamic programme over diagonals.

A run is a stretch of consecutive words with smallest period q and length at least max(MIN_LENGTH, 2q)
that no neighbouring word extends keeping the period. On diagonal (lag) q, where words q apart are
compared, it is a maximal match of length - q words, hence of at least WINDOW = MIN_LENGTH / 2.

Words are read from left to right. Only places whose last WINDOW words occurred before can lie on such a match;
there, each earlier occurrence with another word before it opens a diagonal, whose match length then grows to the
first difference (compared a block of words at a time). If it is long enough, the run is emitted at once. Smaller
lags open first, so of diagonals over one stretch the first has the smallest period.

Inside a run of period q that is already 2q long, two kinds of diagonals are not opened, so that periodic texts
do not open one for each pair of repetitions:
* multiples of q from the run's own first word on: they end with the run and span the same stretch;
* other lags over q between two places inside the run: there they match fewer than q words. Such a match may outlive the run,
  so in the WINDOW - 1 places after a run's end all earlier occurrences are looked at, and matches are followed back to
  where they began.

A word is a maximal run of bytes other than space and 0x09-0x0D, compared exactly. `collapsed` is the text's
words joined by one space, without those that lie in a run after its first period.

Defined cases: null or empty text, or white space alone, has no words, no runs and an empty `collapsed`; repeated
rows are reported each; a long text is searched whole, in memory proportional to its words; an empty table gives
no rows; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.pieces import gathered
from kontor.llm.words import U64, Texts, mix64, per_text, text_slices

MIN_LENGTH = 12
WINDOW = MIN_LENGTH // 2
SLICE_BYTES = 1 << 20
BLOCK = 64

Run = tuple[int, int, int]


def _matched(words: np.ndarray, i: int, lag: int) -> int:
    """The last place from i on up to which words[k] == words[k - lag] (i itself is known to match)."""
    n, size, at = words.size, BLOCK, i + 1
    while at < n:
        differs = words[at: at + size] != words[at - lag: min(at + size, n) - lag]
        first = int(differs.argmax())
        if differs[first]:
            return at + first - 1
        at, size = at + size, 2 * size
    return n - 1


def runs_of(words: np.ndarray, places: np.ndarray, keys: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of one text, by start, then period.

    words: exact word numbers; places: ascending ends of windows that occur more than once, keys: what equal
    windows share (different ones may share it too)."""
    found: dict[tuple[int, int], int] = {}
    seen: dict[int, dict[int, list[int]]] = {}
    ends: dict[int, int] = {}  # lag: last place of its latest match
    inside: list[tuple[int, int, int]] = []  # (lag, first, last place) of matches that make a run
    after: set[int] = set()
    w = words.tolist()

    def opened(i: int, j: int) -> None:
        lag = i - j
        if ends.get(lag, -1) >= i or w[i - WINDOW + 1: i + 1] != w[j - WINDOW + 1: j + 1]:
            return
        first = i - WINDOW + 1
        while first > lag and w[first - 1] == w[first - 1 - lag]:
            first -= 1
        last = ends[lag] = _matched(words, i, lag)
        if last - first + 1 >= max(lag, MIN_LENGTH - lag) and found.setdefault((first - lag, last), lag) == lag:
            inside.append((lag, first, last))
            after.update(range(last + 1, last + WINDOW))

    for i, key in zip(places.tolist(), keys.tolist(), strict=True):
        before = w[i - WINDOW] if i >= WINDOW else -1
        lists = seen.get(key)
        if lists is None:
            seen[key] = {before: [i]}
            continue
        everywhere = i in after
        if inside and inside[0][2] < i or len(inside) > 8:
            inside[:] = [r for r in inside if r[2] >= i]
        # the run whose inner pairs are skipped: of those that hold i after two periods, the one with the most
        here = [r for r in inside if r[1] + r[0] - 1 <= i <= r[2]]
        for word, at in lists.items():
            if word == before and word >= 0 and not everywhere:
                continue
            if everywhere or not here:
                candidates = at
            else:
                lag, first, _ = max(here, key=lambda r: i - r[0] - r[1])
                low, high = bisect_left(at, first + WINDOW - 1), bisect_left(at, i - lag)
                candidates = at if low >= high else at[:low] + at[high:]
            for j in reversed(candidates):
                if not any(i - j > q and (i - j) % q == 0 and j - WINDOW + 1 >= first - q for q, first, _ in here):
                    opened(i, j)
        lists.setdefault(before, []).append(i)
    return sorted((start, last - start + 1, lag) for (start, last), lag in found.items())


def _windows(number: np.ndarray, bounds: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose last WINDOW words occur again in their text, in order, and their windows' keys."""
    if number.size < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    key = mix64(text[WINDOW - 1:].astype(U64) + U64(1))
    for k in range(WINDOW):
        key = mix64(key * U64(3) + number[k: number.size - WINDOW + 1 + k].astype(U64))
    place = np.arange(WINDOW - 1, number.size)
    whole = place - bounds[:-1][text[WINDOW - 1:]] >= WINDOW - 1
    place, key = place[whole], key[whole]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(key.size, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return place[again], key[again]


class Slice:
    """Runs and kept words of a slice of texts."""

    def __init__(self, texts: Texts):
        start, end, text = texts.words()
        self.n, self.bounds = texts.n, per_text(text, texts.n)
        self.data, self.start, self.lens = texts.data, start, end - start
        raw = texts.data[gathered(start, self.lens)]
        cuts = np.concatenate([[0], np.cumsum(self.lens)])
        words = pa.Array.from_buffers(pa.large_binary(), start.size, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])
        number = words.dictionary_encode().indices.to_numpy()
        place, key = _windows(number, self.bounds, text)
        of = text[place]
        edge = np.searchsorted(of, np.arange(self.n + 1))
        self.runs: dict[int, list[Run]] = {}
        for k in np.unique(of).tolist():
            a, b = self.bounds[k], self.bounds[k + 1]
            some = slice(edge[k], edge[k + 1])
            found = runs_of(number[a:b], place[some] - a, key[some])
            if found:
                self.runs[k] = found

    def columns(self) -> list[pa.Array]:
        """n_words, runs, collapsed of every text."""
        flat = np.array([r for k in sorted(self.runs) for r in self.runs[k]], np.int64).reshape(-1, 3)
        sizes = np.zeros(self.n, np.int64)
        sizes[list(self.runs)] = [len(r) for r in self.runs.values()]
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                        pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"]))
        return [pa.array(np.diff(self.bounds)), runs, self._collapsed()]

    def _collapsed(self) -> pa.Array:
        dropped = np.zeros(self.start.size + 1, np.int64)
        for k, runs in self.runs.items():
            for start, length, period in runs:
                dropped[self.bounds[k] + start + period] += 1
                dropped[self.bounds[k] + start + length] -= 1
        kept = np.cumsum(dropped[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(kept)])[self.bounds]
        start, lens = self.start[kept], self.lens[kept] + 1  # one byte more for the space
        last = before[1:][np.diff(before) > 0] - 1
        lens[last] -= 1
        cuts = np.concatenate([[0], np.cumsum(lens)])
        at = gathered(start, lens)
        spaces = np.ones(start.size, bool)
        spaces[last] = False
        raw = self.data[np.minimum(at, max(self.data.size - 1, 0))]
        raw[cuts[1:][spaces] - 1] = 0x20
        return pa.Array.from_buffers(pa.large_utf8(), self.n, [None, pa.py_buffer(cuts[before].tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.utf8())


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_words, runs (start, length, period; by start, then period) and collapsed of every row's text."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(len(keep)), SLICE_BYTES):
                own = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([*own.columns[:len(keep)], *Slice(texts).columns()],
                                                 names=[*keep, "n_words", "runs", "collapsed"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(search, f"{kept}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
