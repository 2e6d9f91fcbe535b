"""Words of Arrow text batches, found and hashed for a whole slice of texts at once.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as
a-z in the hashes. Texts are read straight from the Arrow buffers, a few
megabytes at a time, so memory does not depend on the batch or the number of
texts (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that make up plain words: letters, digits and all bytes of other scripts.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = 0x9E3779B97F4A7C15
CODES = mix64((np.arange(1, 257, dtype=U64) * U64(_STEP)))[FOLD]
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n so far."""
    have = _powers.get(base)
    if have is None or have.size < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Texts:
    """A slice of whole texts: rows first..first+n of the batch, bytes and offsets (n + 1)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = offsets.size - 1

    def words(self, solid: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word (run of `solid` bytes), in order."""
        solid = solid[self.data]
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        lens = np.diff(self.offsets)
        full = lens > 0
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        start = np.flatnonzero(solid & ~before)
        end = np.flatnonzero(solid & ~after) + 1
        text = np.searchsorted(self.offsets, start, side="right") - 1
        return start, end, text

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, letters folded; equal ranges hash alike anywhere."""
        sums = np.zeros(self.data.size + 1, dtype=U64)
        np.cumsum(CODES[self.data] * _power(_BASE, self.data.size), out=sums[1:])
        return mix64((sums[end] - sums[start]) * _power(_INVERSE, self.data.size + 1)[start])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of about `limit` bytes of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds, raw = column.buffers()[1], column.buffers()[2]
    if len(column) == 0:
        return
    offsets = np.frombuffer(bounds, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Texts(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def per_text(text: np.ndarray, n: int) -> np.ndarray:
    """Bounds (n + 1) of each text's entries in a list ordered by text."""
    return np.searchsorted(text, np.arange(n + 1))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each text, and their text numbers.

    A text with fewer words (but at least one) gives its whole sequence as one shingle.
    """
    n = bounds.size - 1
    lens = np.diff(bounds)
    text = np.repeat(np.arange(n), lens)
    total = hashes.size
    run = np.zeros(total, dtype=U64)
    for k in range(width):
        part = np.zeros(total, dtype=U64)
        part[: max(total - k, 0)] = hashes[k:]
        inside = np.arange(total) + k < bounds[1:][text]
        run = np.where(inside, mix64(run * U64(3) + part + U64(k + 1)), run)
    pos = np.arange(total) - bounds[:-1][text]
    keep = pos <= np.maximum(lens - width, 0)[text]
    return run[keep], text[keep]
