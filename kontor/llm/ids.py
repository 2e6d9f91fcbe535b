"""Token-id output: compressed documents with a shared dictionary and an offset index.

A store is a folder with `dictionary` and pack files. A pack holds the documents
of one range of ids in order: a header with the hash of the dictionary, one zstandard frame per
document (its ids as little-endian unsigned 32-bit integers, compressed alone against the
shared dictionary) and an index with each document's id, frame offset and token count, so a
short document costs one small read. Packs are written under names of their own attempt; only
those of tasks that ended well are listed by `packs`.

Texts are encoded word by word: white space separates the tokenizer's pieces, so a
text's ids are the ids of its words in order, and each distinct word is encoded
once. Plain words (ASCII and Latin-1 letters) are cut as the tokenizer's pattern
cuts them and their pieces go to its BPE model; any other word goes through the whole tokenizer.

The dictionary is trained on at most SAMPLE_DOCS documents of up to SAMPLE_BYTES bytes, those with the
smallest hash; all documents are written.

Defined cases: null or empty text is the end id alone; a null doc_id comes first; repeated rows
are written each, equal ids in order of their text's hash; an empty table gives no packs; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm.scratch import scratch_dir, stored
from kontor.llm.words import FOLD, U64, Texts, mix64, per_text, text_slices

END_ID = 1
LEVEL = 3
SAMPLE_DOCS = 1024
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
CACHED_WORDS = 400_000

MAGIC = b"KZID1\0\0\0"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("n_tokens", "<u4"), ("offset", "<u8"), ("length", "<u8")])

#: Pieces of a lower-cased word of ASCII and Latin-1 letters, as in the tokenizer's own pattern (fixed).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_characters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts; keeps the ids of up to CACHED_WORDS words, one after the other in `flat`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces.model._resize_cache(0)  # pieces come once each: the model's cache would only cost time
        characters = _byte_characters()
        #: Lower-case Latin-1 letters and their bytes' characters, none of which is such a letter.
        self.letters = [(chr(c), "".join(characters[b] for b in chr(c).encode())) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(CACHED_WORDS + 1, np.int64)

    def _keep(self, keys: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Words with their ids; ends: where each word's ids end in `ids`."""
        n = len(self.number)
        at = int(self.bounds[n])
        while at + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at: at + ids.size] = ids
        self.bounds[n + 1: n + 1 + len(keys)] = at + ends
        self.number.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and their bounds."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 2000):
            some = pieces[i: i + 2000]
            line = " ".join(some)
            if not line.isascii():
                for letter, characters in self.letters:
                    line = line.replace(letter, characters)
            code = self.pieces.encode(line, add_special_tokens=False)
            ids.append(np.array(code.ids, np.uint32))
            sizes.append(np.bincount(np.array(code.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _learn_plain(self, keys: list[int], words: list[bytes], single: list[bool]) -> None:
        """Words of ASCII and Latin-1 letters, in lower case; single: letters only, hence one piece."""
        for i in range(0, len(words), 20_000):
            some = words[i: i + 20_000]
            counts = np.ones(len(some), np.int64)
            number: dict[str, int] = {}  # words share pieces, above all punctuation
            use: list[int] = []
            for k, (word, one) in enumerate(zip(some, single[i: i + 20_000], strict=True)):
                if one:
                    use.append(number.setdefault(word.decode(), len(number)))
                else:
                    pieces = PIECES.findall(word.decode())
                    counts[k] = len(pieces)
                    use += [number.setdefault(p, len(number)) for p in pieces]
            ids, bounds = self._plain_ids(list(number))
            begin, size = bounds[use], np.diff(bounds)[use]
            ends = np.cumsum(size)
            self._keep(keys[i: i + 20_000], ids[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)], ends[np.cumsum(counts) - 1])

    def _learn_whole(self, keys: list[int], words: list[bytes]) -> None:
        codes = [c.ids for c in self.whole.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        self._keep(keys, np.fromiter(itertools.chain.from_iterable(codes), np.uint32), np.cumsum([len(c) for c in codes], dtype=np.int64))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and their bounds (n + 1)."""
        start, end, text = texts.words()
        data = texts.data
        pair = np.zeros(data.size + 1, bool)  # second bytes of letters in the range 0xC3, signs aside
        pair[1:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        latin = pair[:-1] | pair[1:]
        odd = ((data >= 0x80) & ~latin) | (data < 0x20) | (data == 0x7F)
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # may open a special token
        lower = FOLD[data] + (pair[:-1] & (data < 0x9F)).astype(np.uint8) * np.uint8(0x20)
        other = ~(latin | ((lower >= 0x61) & (lower <= 0x7A)))
        inside = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[np.stack([start, end])], axis=0)[0] > 0
        hard = inside(odd)
        keys = texts.hashes(start, end)
        if hard.any():
            keys = np.where(hard, mix64(_exact(texts, start, end) ^ U64(0x5BD1E995)), keys)
        distinct, first, use = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        numbers = np.fromiter(map(self.number.get, names, itertools.repeat(-1)), np.int64, len(names))
        if len(self.number) + (numbers < 0).sum() > CACHED_WORDS:
            self._forget()
            numbers[:] = -1
            if len(names) > CACHED_WORDS:
                self.bounds = np.zeros(len(names) + 1, np.int64)
        missing = np.flatnonzero(numbers < 0)
        if missing.size:
            at, tough, more = first[missing], hard[first[missing]], inside(other)[first[missing]]
            cut = lambda raw, which: [raw[s:e] for s, e in zip(start[at[which]].tolist(), end[at[which]].tolist(), strict=True)]
            self._learn_plain(distinct[missing[~tough]].tolist(), cut(lower.tobytes(), ~tough), (~more[~tough]).tolist())
            if tough.any():
                self._learn_whole(distinct[missing[tough]].tolist(), cut(data.tobytes(), tough))
            numbers[missing] = [self.number[names[i]] for i in missing.tolist()]
        word = numbers[use]
        begin = self.bounds[word]
        n_of = self.bounds[word + 1] - begin
        ends = np.concatenate([[0], np.cumsum(n_of)])
        out = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n_of)]
        return out, ends[per_text(text, texts.n)]


def _exact(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges with their case: the folded hash and one of which bytes are upper case."""
    upper = (texts.data >= 0x41) & (texts.data <= 0x5A)
    marked = Texts(0, np.where(upper, np.uint8(2), np.uint8(3)), texts.offsets)
    return texts.hashes(start, end) ^ mix64(marked.hashes(start, end))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so its words serve all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, end_id: int) -> bytes:
    return np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty if they give none."""
    short = F.octet_length("text").between(1, SAMPLE_BYTES)
    n = docs.filter(short).count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # about 4 * SAMPLE_DOCS texts pass the threshold and are sorted, however many there are
    some = docs.filter(short & (draw <= min(1 << 40, (4 * SAMPLE_DOCS << 40) // max(n, 1))))
    sample = some.select("text", draw.alias("h")).orderBy("h", "text").limit(SAMPLE_DOCS).collect()
    arrays = []
    for texts in text_slices(pa.array([r.text for r in sample], pa.string())):
        ids, bounds = encoder(tokenizer).encode(texts)
        arrays += [_with_end(ids[a:b], end_id) for a, b in itertools.pairwise(bounds.tolist())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too even samples to train on
        return b"".join(arrays)[:DICTIONARY_BYTES] if len(arrays) > 1 else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


class Pack:
    """Random access to one pack."""

    def __init__(self, path: str, dictionary: bytes):
        fs, where = _open(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC):] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} is no pack of this dictionary")
        n, = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, size - 8 - n * INDEX.itemsize), INDEX)
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> bytes:
        """Serialised ids of the pack's i-th document."""
        row = self.index[i]
        return self.reader.decompress(self.file.read_at(int(row["length"]), int(row["offset"])),
                                      max_output_size=4 * int(row["n_tokens"]))


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode and write all documents in ascending doc_id order; (folder, packs).

    packs: pack (ascending with doc_id), path, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "ids")
    raw = train_dictionary(docs, tokenizer, end_id)
    fs, where = _open(path)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/dictionary") as out:
        out.write(raw)
    mark = hashlib.sha256(raw).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(path)
        number, name = TaskContext.get().partitionId(), None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        rows, at, out = [], len(MAGIC) + 32, None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for texts in text_slices(batch.column(1)):
                if out is None:
                    name = f"pack-{number:07d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{where}/{name}")
                    out.write(MAGIC + mark)
                ids, bounds = encoder(tokenizer).encode(texts)
                for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
                    frame = packer.compress(_with_end(ids[a:b], end_id))
                    doc = doc_ids[texts.first + k]
                    rows.append((doc or 0, doc is None, b - a + 1, at, len(frame)))
                    at += len(frame)
                    out.write(frame)
        if out is not None:
            index = np.array(rows, INDEX)
            out.write(index.tobytes())
            out.write(struct.pack("<Q", len(rows)))
            out.close()
            yield pa.RecordBatch.from_pydict({"pack": pa.array([number], pa.int64()), "path": [f"{path}/{name}"],
                                              "n_docs": pa.array([len(rows)], pa.int64()),
                                              "n_tokens": pa.array([int(index["n_tokens"].sum(dtype=np.int64))], pa.int64())})

    key = F.xxhash64("text")
    placed = (docs.select(F.col("doc_id").cast("long"), "text", key.alias("h")).repartitionByRange("doc_id", "h")
              .sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    packs = stored(placed.mapInArrow(write, "pack long, path string, n_docs long, n_tokens long"), "ids-packs")
    return path, packs


def read_store(spark: SparkSession, path: str, packs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the packs themselves."""
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    placed = packs.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(path)
        with fs.open_input_file(f"{where}/dictionary") as f:
            raw = f.read()
        for batch in batches:
            for pack_path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pack = Pack(pack_path, raw)
                lens = pack.index["n_tokens"].astype(np.int64)
                starts = base + np.cumsum(lens) - lens
                sums, counts = [], []
                for i in range(len(pack.index)):
                    found = pack.ids(i)
                    sums.append(zlib.crc32(found))
                    counts.append(len(found) // 4)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(pack.index["doc_id"].astype(np.int64), mask=pack.index["null"].astype(bool)),
                    "start": starts, "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    n = max(1, packs.count())
    return (placed.select("path", "base").repartition(n, "path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
