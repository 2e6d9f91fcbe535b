"""Language identification by cross-parsing.

Per language a suffix automaton of labelled text recognises every substring of
it. A text is parsed greedily into the longest phrases that occur in a
language's text; each phrase costs log2 of the length of that text, and the
language with the fewest such bits per byte wins.

The automata are laid out as one flat transition table each, in which a missing
arc already leads to where the next phrase starts, with the phrases it ends.
All texts of a slice are cut into runs of RUN bytes (every byte is parsed; a
phrase also ends with its run) and all runs step through a table together.

Bytes are folded first: upper to lower case (A-Z and the Latin-1 letters), and
runs of anything that is no letter or high byte to one space.

Fitting takes at most SAMPLE_DOCS documents per language, those with the smallest hash of
their id, and of them about SAMPLE_BYTES: every picked row has the same share, and a text longer than its share gives
pieces of PIECE characters at even steps over its whole length, cut before they are collected. Everything else covers all data.

Defined cases: null text or text without any letter is `und` with score 0, and so is
every text if nothing is labelled; equal costs go to the language first by name; null labels don't
train; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.words import FOLD, Texts, text_slices

SAMPLE_DOCS = 64
SAMPLE_BYTES = 32 << 10
PIECE = 128
RUN = 512
SLICE_BYTES = 512 << 10
UNKNOWN = "und"

_CLASS = FOLD.copy()
_CLASS[[b for b in range(128) if not 0x61 <= FOLD[b] <= 0x7A]] = 0x20


def folded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts and their bounds; no run of spaces, not even across two texts."""
    data = _CLASS[texts.data]
    if not data.size:
        return data, texts.offsets
    before = np.concatenate([[0], texts.data[:-1]])
    upper = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data = np.where(upper, data + 0x20, data).astype(np.uint8)
    keep = np.ones(data.size, bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[texts.offsets]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings of `codes`."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in arcs[at]:
            arcs[at][code] = new
            at = link[at]
        if at >= 0:
            there = arcs[at][code]
            if length[there] == length[at] + 1:
                link[new] = there
            else:
                split = len(arcs)
                arcs.append(dict(arcs[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                while at >= 0 and arcs[at].get(code) == there:
                    arcs[at][code] = split
                    at = link[at]
                link[there] = link[new] = split
        last = new
    return arcs


class Language:
    """One language's automaton as a flat table over `alphabet` codes (0: not in any sample, last: end of run).

    An entry is next state * 4 + phrases ended by the step.
    """

    def __init__(self, name: str, sample: bytes, alphabet: np.ndarray):
        self.name, self.bits = name, float(np.log2(max(len(sample), 2)))
        arcs = suffix_automaton(alphabet[np.frombuffer(sample, np.uint8)].tolist())
        self.width = int(alphabet.max()) + 2
        root = np.full(self.width, 2, np.int32)
        for code, to in arcs[0].items():
            root[code] = to * 4 + 1
        table = np.tile(root, (len(arcs), 1))
        table[0] = 1
        table[:, -1] = np.arange(len(arcs)) * 4
        state, code, to = (np.array(x, np.int64) for x in zip(*[(s, c, t) for s, a in enumerate(arcs) for c, t in a.items()], strict=True))
        table[state, code] = to * 4
        self.table = table.ravel()

    def phrases(self, runs: np.ndarray) -> np.ndarray:
        """Phrases of each run; runs: (RUN, number of runs) codes."""
        state = np.zeros(runs.shape[1], np.int32)
        ended = np.zeros(runs.shape[1], np.int32)
        for step in runs:
            entry = self.table[state * self.width + step]
            ended += entry & 3
            state = entry >> 2
        return ended + (state > 0)


class Model:
    """All languages; `alphabet` maps folded bytes to codes."""

    def __init__(self, samples: dict[str, bytes]):
        used = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.alphabet = np.zeros(256, np.int32)
        self.alphabet[used] = np.arange(1, used.size + 1)
        self.languages = [Language(name, samples[name], self.alphabet) for name in sorted(samples)]

    def costs(self, texts: Texts) -> np.ndarray:
        """Bits per byte of each text (rows) in each language."""
        data, offsets = folded(texts)
        lens = np.diff(offsets)
        n_runs = -(-lens // RUN)
        text = np.repeat(np.arange(texts.n), n_runs)
        nth = np.arange(text.size) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        codes = np.full(text.size * RUN, int(self.alphabet.max()) + 1, np.int32)
        to = np.arange(data.size) - np.repeat(offsets[:-1], lens) + np.repeat((np.cumsum(n_runs) - n_runs) * RUN, lens)
        codes[to] = self.alphabet[data]
        runs = np.ascontiguousarray(codes.reshape(-1, RUN)[: nth.size].T)
        out = np.empty((texts.n, len(self.languages)))
        for k, language in enumerate(self.languages):
            total = np.bincount(text, weights=language.phrases(runs), minlength=texts.n)
            out[:, k] = total * language.bits / np.maximum(lens, 1)
        return out


def fit(docs: DataFrame, train: Column) -> Model:
    """Automata from a bounded sample of the labelled rows that `train` names."""
    labelled = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = labelled.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    # about 4 * SAMPLE_DOCS rows of a language pass the threshold, however many it has
    picked = (labelled.select("lang", "doc_id", "text", draw.alias("draw")).join(F.broadcast(known), "lang")
              .filter(F.col("draw") * F.col("count") <= F.lit(4 * SAMPLE_DOCS * (1 << 40)).cast("decimal(38,0)"))
              .withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_DOCS)
              .withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("lang")))
              .select("lang", "nth", shared_part("text", F.lit(SAMPLE_BYTES) / F.col("rows")).alias("part"))
              .orderBy("lang", "nth").collect())
    samples: dict[str, bytes] = {}
    for row in picked:
        for texts in text_slices(pa.array([row.part])):
            samples[row.lang] = samples.get(row.lang, b"") + folded(texts)[0].tobytes() + b" "
    return Model({lang: sample for lang, sample in samples.items() if sample.strip()})


def shared_part(text: str, share: Column) -> Column:
    """The text, or about `share` bytes of it: pieces of PIECE characters at even steps, joined by spaces."""
    size = F.length(text)
    # in characters, as texts of some scripts take two or three bytes for each
    pieces = F.greatest(F.lit(1), F.floor(share * size / F.greatest(F.octet_length(text), F.lit(1)) / PIECE)).cast("int")
    at = lambda i: F.substring(F.col(text), (F.floor(i * size / pieces) + 1).cast("int"), F.lit(PIECE))
    cut = F.array_join(F.transform(F.sequence(F.lit(0), pieces - 1), at), " ")
    return F.when(F.octet_length(text) <= share, F.col(text)).otherwise(cut)


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The `keep` columns with lang_pred and score (0 to 1: how far the best language is ahead of the second)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.rlike(r"\p{L}").alias("_letters"), text.alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predicting(shared), schema)


def _predicting(shared) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([x.name for x in model.languages], dtype=object)
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for texts in text_slices(batch.column("_text"), SLICE_BYTES) if names.size else ():
                costs = model.costs(texts)
                at = slice(texts.first, texts.first + texts.n)
                order = np.sort(costs, axis=1)
                ahead = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-300) if names.size > 1 else np.ones(texts.n)
                pred[at] = np.where(letters[at], names[np.argmin(costs, axis=1)], UNKNOWN)
                score[at] = np.where(letters[at], np.clip(ahead, 0, 1), 0.0)
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names[:-2], "lang_pred", "score"])
    return label
