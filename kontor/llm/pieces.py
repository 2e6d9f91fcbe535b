"""SentencePiece encoding and decoding as vectorised merge rounds.

The symbols of a slice's distinct segments lie in flat numpy arrays. Each round finds the best pair
rank of every word (a segmented minimum), merges all its occurrences at once, leftmost first
where they overlap, and compacts the arrays; words without a pair leave. The order of merges is that
of the library's queue:

* Pairs of one rank merge left to right. A merge could make a pair of the same or a better rank
  (the vocabulary has such pieces: `hasty`), which the queue takes before the next occurrence. Then only occurrences
  that lie further from the one before than two longest pieces merge in one round.
* No piece crosses some pairs of neighbouring characters (as any character and a space after it): texts
  are cut there, so equal segments are encoded once a slice, and a word's rounds depend on its own length.

A character without a piece becomes the ids of its UTF-8 bytes.

Defined cases: null or empty text gives the begin and end ids alone and decodes to the empty text; repeated
rows are encoded each; a long text is encoded in parts of about SLICE_BYTES, cut between segments
(one segment is never cut, whatever its length); an empty table gives no rows; extra columns are ignored unless named
in `keep`. Models other than BPE with byte fallback, the identity normaliser and a leading space are refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.words import Texts, text_slices

SLICE_BYTES = 1 << 20
SPACE_SYMBOL = "▁"
NONE = np.int32(2**31 - 1)
MARK = np.frombuffer(SPACE_SYMBOL.encode(), np.uint8)


def gathered(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of all ranges [start, start + len), one range after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - (ends - lens), lens)


class Model:
    """The vocabulary as arrays: pair table, ranks, piece bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        with open(path, "rb") as file:
            raw = file.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        kind, norm, train = spec.SentencePiece, spec.normalizer_spec, spec.trainer_spec
        odd = {p.type for p in spec.pieces} - {kind.NORMAL, kind.CONTROL, kind.UNKNOWN, kind.BYTE}
        if (odd or train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix):
            raise ValueError(f"{path}: only BPE models with byte fallback and a plain leading space can be encoded here")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        pieces = [p.piece for p in spec.pieces]
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.size = len(pieces)
        self._pairs(normal, np.array([p.score for p in spec.pieces]))
        self._bytes(spec, kind)
        self._spaces(normal)

    def _pairs(self, normal: dict[str, int], scores: np.ndarray) -> None:
        """Sorted pair keys (left * span + right) with the merged piece; ranks by falling score, ties share one."""
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int32)
        letters = sorted({c for p in normal for c in p})
        symbol = normal | {c: self.size + i for i, c in enumerate(letters) if c not in normal}
        self.unknown = self.size + len(letters)
        self.span = self.unknown + 1
        self.letters = len(letters)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letter_symbol = np.array([symbol[c] for c in letters] + [self.unknown], np.int32)
        keys, merged, hasty, neighbours = [], [], np.zeros(self.span, bool), set()
        for piece, i in normal.items():
            neighbours.update(itertools.pairwise(piece))
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.span + right)
                    merged.append(i)
                    for part in (left, right):
                        if part < self.size and self.rank[i] <= self.rank[part]:
                            hasty[part] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.hasty = hasty
        self.reach = 2 * max(map(len, normal), default=1)
        self.spaced = any(b == SPACE_SYMBOL and a != SPACE_SYMBOL for a, b in neighbours)
        at = {c: i for i, c in enumerate(letters)}
        pairs = np.array([at[a] * len(letters) + at[b] for a, b in neighbours], np.int64)
        self.joined = np.zeros(len(letters) ** 2 // 8 + 1, np.uint8)  # one bit for each pair of letters
        np.bitwise_or.at(self.joined, pairs >> 3, np.uint8(1) << (pairs & 7).astype(np.uint8))

    def _bytes(self, spec, kind) -> None:
        """What each id decodes to, and the ids of single bytes."""
        self.byte_id = np.zeros(256, np.int32)
        raw, self.is_byte, self.is_control = [], np.zeros(self.size, bool), np.zeros(self.size, bool)
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[3:5], 16)], self.is_byte[i] = i, True
                raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kind.CONTROL:
                self.is_control[i] = True
                raw.append(b"")
            else:
                text = spec.trainer_spec.unk_surface if p.type == kind.UNKNOWN else p.piece.replace(SPACE_SYMBOL, " ")
                raw.append(text.encode())
        self.opens = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE_SYMBOL) for p in spec.pieces])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def _spaces(self, normal: dict[str, int]) -> None:
        """Where all pieces of spaces share the last rank, they are merged after everything else and from the
        left. If a run then fills longest pieces one by one, it is cut behind each of them."""
        runs = [p for p in normal if len(p) > 1 and set(p) == {SPACE_SYMBOL}]
        last = max((int(self.rank[i]) for p, i in normal.items() if len(p) > 1), default=0)
        self.run = 0
        if runs and {int(self.rank[normal[p]]) for p in runs} == {last}:
            longest = max(runs, key=len)
            if self.library.encode(" " * (4 * len(longest) - 1)) == [normal[longest]] * 4:
                self.run = len(longest)

    # --- encoding ----------------------------------------------------------------------------

    def _starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where segments start: at texts' first bytes, and at a space after something else."""
        start = np.zeros(data.size, bool)
        start[first] = True
        if self.spaced:
            return np.flatnonzero(start)
        space = data == 0x20
        mark = np.zeros(data.size, bool)  # last byte of a space symbol in the text itself
        if data.size > 2:
            mark[2:] = (data[2:] == MARK[2]) & (data[1:-1] == MARK[1]) & (data[:-2] == MARK[0])
        start[1:] |= space[1:] & ~space[:-1] & ~mark[:-1]
        if self.run:
            at = np.arange(data.size)
            opened = np.maximum.accumulate(np.where(start | ~space | np.concatenate([[False], mark[:-1]]), at, 0))
            past = at - opened
            start |= space & space[opened] & start[opened] & (past > 0) & (past % self.run == 0)
        return np.flatnonzero(start)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, without begin and end, and their bounds (n + 1)."""
        full = np.diff(texts.offsets) > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(texts.n + 1, np.int64)
        data = np.insert(texts.data, texts.offsets[:-1][full], 0x20)
        offsets = texts.offsets + np.concatenate([[0], np.cumsum(full)])
        starts = self._starts(data, offsets[:-1][full])
        ends = np.append(starts[1:], data.size).astype(np.int32)
        bounds = pa.py_buffer(np.append(starts.astype(np.int32), ends[-1:]).tobytes())
        segments = pa.Array.from_buffers(pa.utf8(), starts.size, [None, bounds, pa.py_buffer(data.tobytes())])
        coded = segments.dictionary_encode()
        ids, cuts = self._encode_distinct(coded.dictionary)
        use = coded.indices.to_numpy()
        lens = np.diff(cuts)[use]
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids[gathered(cuts[:-1][use], lens)], total[np.searchsorted(starts, offsets)]

    def _encode_distinct(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every segment and their bounds."""
        text = pc.replace_substring(segments, " ", SPACE_SYMBOL)
        joined = "".join(text.to_pylist())
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edge = np.concatenate([[0], np.cumsum(pc.utf8_length(text).to_numpy())])
        letter = self.letter[code]
        symbol = self.letter_symbol[letter]
        cut = np.ones(code.size, bool)  # words: maximal stretches whose neighbours occur together in some piece
        pair = np.maximum(letter[:-1], 0) * np.int64(self.letters) + np.maximum(letter[1:], 0)
        together = (self.joined[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1
        cut[1:] = (together == 0) | (letter[:-1] < 0) | (letter[1:] < 0)
        cut[edge[:-1]] = True
        left = self._merge(symbol, np.cumsum(cut))
        own = left >= self.size  # characters without a piece: their bytes
        lens = np.where(left < 0, 0, 1)
        if own.any():
            lens[own] = 1 + (code[own] >= 0x80) + (code[own] >= 0x800) + (code[own] >= 0x10000)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        ids = np.zeros(bounds[-1], np.int32)
        ids[bounds[:-1][(left >= 0) & ~own]] = left[(left >= 0) & ~own]
        if own.any():
            raw = np.frombuffer(code[own].tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[gathered(bounds[:-1][own], lens[own])] = self.byte_id[raw]
        return ids, bounds[edge]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of symbol pairs; NONE where they don't merge."""
        if not self.keys.size:
            return np.full(left.size, NONE), np.zeros(left.size, np.int32)
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        piece = self.merged[at]
        return np.where(self.keys[at] == key, self.rank[piece], NONE), piece

    def _merge(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The symbol left at each character's place, -1 where another one holds it."""
        out = np.full(symbol.size, -1, np.int32)
        symbol, place = symbol.astype(np.int32), np.arange(symbol.size)
        rank, piece = np.full(symbol.size, NONE), np.zeros(symbol.size, np.int32)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], piece[same] = self._look(symbol[same], symbol[same + 1])
        while symbol.size:
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, word.size))
            if (best == NONE).any():
                live = np.repeat(best != NONE, size)
                out[place[~live]] = symbol[~live]
                symbol, place, word, rank, piece = (x[live] for x in (symbol, place, word, rank, piece))
                size, best = size[best != NONE], best[best != NONE]
                if not symbol.size:
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[self._chosen(at, word, place, self.hasty[piece[at]])]
            symbol[at] = piece[at]
            stay = np.ones(symbol.size, bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, place, word, rank, piece = (x[stay] for x in (symbol, place, word, rank, piece))
            touched = np.zeros(symbol.size, bool)
            touched[moved[at]] = True
            touched[:-1] |= touched[1:]
            rank[touched] = NONE
            touched[:-1] &= word[:-1] == word[1:]
            touched[-1] = False
            again = np.flatnonzero(touched)
            rank[again], piece[again] = self._look(symbol[again], symbol[again + 1])
        return out

    def _chosen(self, at: np.ndarray, word: np.ndarray, place: np.ndarray, hasty: np.ndarray) -> np.ndarray:
        """Which of the best pairs merge in this round: every other one of those that overlap; where one
        may set off merges of its own, only those far from the pair before."""
        fresh = np.ones(at.size, bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(at.size), 0))
        choose = (np.arange(at.size) - run) % 2 == 0
        if hasty.any():
            same = word[at[1:]] == word[at[:-1]]
            # ranks may be shared by pieces of which only some are hasty: one is enough to wait
            slow = np.zeros(at.size, bool)
            slow[1:] = same & (place[at[1:]] - place[at[:-1]] <= self.reach)
            number = np.cumsum(np.concatenate([[True], ~same])) - 1
            choose = np.where(np.bincount(number, weights=hasty)[number] > 0, ~slow, choose)
        return choose

    # --- decoding ----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each list of ids: pieces joined, spaces for space symbols, without the first piece's one."""
        lens = np.diff(self.raw_bounds)[ids]
        cuts = np.concatenate([[0], np.cumsum(lens)])
        raw = self.raw[gathered(self.raw_bounds[:-1][ids], lens)].tobytes()
        shown = np.flatnonzero(~self.is_control[ids])
        at = np.searchsorted(shown, bounds[:-1])
        head = shown[np.minimum(at, max(shown.size - 1, 0))] if shown.size else np.zeros(bounds.size - 1, np.int64)
        strip = (at < np.searchsorted(shown, bounds[1:])) & self.opens[ids[head]] if ids.size else np.zeros(bounds.size - 1, bool)
        begin, end = cuts[bounds[:-1]] + strip, cuts[bounds[1:]]
        return [self._valid(raw[a:b], ids[i:j]) for a, b, (i, j) in
                zip(begin.tolist(), end.tolist(), itertools.pairwise(bounds.tolist()), strict=True)]

    def _valid(self, raw: bytes, ids: np.ndarray) -> bytes:
        """`raw`, unless byte ids in it make no UTF-8: the library then replaces every stray byte."""
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist()).encode()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _parts(texts: Texts, limit: int) -> Iterator[Texts]:
    """One long text in parts of about `limit` bytes; each starts with a space after a plain letter, which
    `encode` puts there itself, so the space is left out."""
    data, at, n = texts.data, 0, texts.data.size
    while at < n:
        end = n
        if n - at > limit:
            space = data[at + limit:] == 0x20
            space[0] = space[-1] = False  # a part is never empty
            space[1:] &= (data[at + limit: -1] > 0x20) & (data[at + limit: -1] < 0x7F)
            found = int(space.argmax())
            end = at + limit + found if space[found] else n
        yield Texts(0, data[at:end], np.array([0, end - at]))
        at = end + 1


def encoded(texts: Texts, m: Model, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice's texts with begin and end ids, and their bounds."""
    if texts.n == 1 and texts.data.size > 2 * limit and not m.spaced:
        parts = [m.encode(part)[0] for part in _parts(texts, limit)]
        ids, bounds = np.concatenate(parts), np.array([0, sum(p.size for p in parts)])
    else:
        ids, bounds = m.encode(texts)
    out = np.full(ids.size + 2 * texts.n, m.begin, np.int32)
    at = np.arange(texts.n)
    out[gathered(bounds[:-1] + 2 * at + 1, np.diff(bounds))] = ids
    out[bounds[1:] + 2 * at + 1] = m.end
    return out, bounds + 2 * np.arange(texts.n + 1)


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), bounds.size - 1, [None, pa.py_buffer((4 * bounds).astype(np.int64).tobytes()),
                                                                     pa.py_buffer(raw)]).cast(pa.binary())


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of every row's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for texts in text_slices(batch.column(len(keep)), SLICE_BYTES):
                ids, bounds = encoded(texts, m)
                own = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([*own.columns[:len(keep)], pa.array(np.diff(bounds)), _packed(ids, bounds)],
                                                 names=[*keep, "n_tokens", "ids"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and `decoded`, the text of the packed ids; a null `ids` is an empty list."""
    names = rows.columns
    number = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in text_slices(pc.fill_null(batch.column(number), b""), 4 * SLICE_BYTES):
                texts = m.decode(np.frombuffer(part.data.tobytes(), "<u4").astype(np.int64), part.offsets // 4)
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.n).columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=[*names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, decoded string")
