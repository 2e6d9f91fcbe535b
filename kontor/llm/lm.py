"""Language-model scoring with a weighted backoff automaton.

Model: n-grams up to `order` with interpolated absolute discounting over words and
an end token. Its automaton has a root state, whose arcs carry log10 P(w), and one
state per context of 1 to order - 1 words seen in training, whose arcs carry the
log10 probability of every n-gram seen there; from any state a failure arc with the
weight of the discounted mass leads to the state of the context without its first
word, at last to the root. A text is scored in one left-to-right traversal: it
carries the state, follows failure arcs until the state has an arc for the token
(the root has one for any), adds up their weights, and moves on to the context one
word longer, or the longest suffix of it that is a state. P(unknown word) is the
discounted mass of all known words, so probabilities over known words and the
unknown class sum to 1.

All texts of a block are traversed side by side, a long one in lanes: a lane starts
order - 1 tokens before its own, after which its state is that of the whole text,
as a state never depends on more tokens than that.

The model grows with the corpus and is never held whole. Documents are packed
into blocks; every block sends its distinct n-grams with their training counts
to buckets by context, as sorted arrays; a bucket sums them over all blocks
and answers each block in the order it asked, with the totals of its n-grams
and contexts. A block's answers are the part of the automaton that its texts can
reach. Contexts that hold more than 1/HOT of a block's words somewhere (at most
HOT of each length overall) are spread over all buckets by the word that follows.

Defined cases: null or empty text is the end token alone; a null doc_id counts as
the empty text for the split, so it trains; repeated rows count and are scored
each; without training tokens every probability is 1 (scores 0.0); extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.scratch import stored
from kontor.llm.words import U64, mix64, per_text, text_slices

BLOCK_BYTES = 4 << 20
HOT = 2000
ORDER = 2
LANE = 512
START = U64(0x5354415254)
END = U64(0x454E44)

BLOCKS = ("block long, doc_ids array<long>, train array<boolean>, offsets array<int>, payload binary, "
          "hot_words binary, hot_lengths binary, hot_counts binary, n_tokens long")
ASKS = "bucket int, block long, words binary, lengths binary, runs binary, nexts binary, counts binary"
ANSWERS = "block long, bucket int, totals binary, words binary, kinds binary, stats binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), dtype=kind)


def _pack_totals(values: np.ndarray) -> bytes:
    """Corpus totals in the narrowest width that holds them all, told by the first byte."""
    wide = values.max(initial=0) >= 1 << 32
    return (b"\x08" if wide else b"\x04") + _pack(values.astype(np.int64 if wide else np.uint32))


def _unpack_totals(raw: bytes) -> np.ndarray:
    return _unpack(raw[1:], np.int64 if raw[0] == 8 else np.uint32)


def _tokens(payload: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's texts and their bounds per text."""
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=1 << 31)
    column = pa.Array.from_buffers(pa.string(), offsets.size - 1,
                                   [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    hashes, bounds = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for texts in text_slices(column):
        start, end, text = texts.words()
        hashes.append(texts.hashes(start, end))
        bounds.append(per_text(text, texts.n)[1:] + bounds[-1][-1])
    return np.concatenate(hashes), np.concatenate(bounds)


def _longer(before: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, tokens that have a context of that length, its hash) for lengths 2 to order - 1;
    `before`: the token before each, `at`: each token's number in its text."""
    context = before
    for length in range(2, order):
        context = np.concatenate([context[:1], mix64(context[:-1] * U64(3) + before[1:] + U64(length))])
        held = np.flatnonzero(at >= length - 1)
        yield length, held, context[held]


def _packing(order: int) -> Callable:
    def often(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of every length that hold over 1/HOT of the block's words: hash, length, count."""
        found = [(1, hashes)]
        if order > 2:
            sequence = _Sequence(hashes, bounds)
            found += [(length, context) for length, _, context in _longer(sequence.before, sequence.at, order)]
        listed = []
        for length, context in found:
            words, counts = np.unique(context, return_counts=True)
            pick = counts * HOT > hashes.size
            listed.append((words[pick], np.full(int(pick.sum()), length, np.int64), counts[pick].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*listed, strict=True))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, train, texts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, ids, train, texts, held
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            hashes, bounds = _tokens(payload, offsets)
            words, lengths, counts = often(hashes, bounds)
            row = {"block": [(task << 24) + number], "doc_ids": [ids], "train": [train], "offsets": [offsets.tolist()],
                   "payload": [payload], "hot_words": [words.tobytes()], "hot_lengths": [lengths.tobytes()],
                   "hot_counts": [counts.tobytes()], "n_tokens": [hashes.size]}
            number, ids, train, texts, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for batch in batches:
            for doc, trains, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py() or ""
                raw = raw.encode()
                ids.append(doc), train.append(trains), texts.append(raw)
                held += len(raw) + 64
                if held >= BLOCK_BYTES:
                    yield block()
        if ids:
            yield block()
    return pack


_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                     ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("hot_words", pa.binary()),
                     ("hot_lengths", pa.binary()), ("hot_counts", pa.binary()), ("n_tokens", pa.int64())])


class _Sequence:
    """The tokens of a block's texts in order, each with its text, the token before it and its number in the text."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        n_docs = bounds.size - 1
        self.ends = bounds[1:] + np.arange(1, n_docs + 1)
        self.starts = bounds[:-1] + np.arange(n_docs)
        self.tokens = np.empty(hashes.size + n_docs, U64)
        word = np.ones(self.tokens.size, bool)
        word[self.ends - 1] = False
        self.tokens[word], self.tokens[self.ends - 1] = hashes, END
        self.doc = np.repeat(np.arange(n_docs), np.diff(bounds) + 1)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = START
        self.at = np.arange(self.tokens.size) - self.starts[self.doc]


class _Grams(_Sequence):
    """Distinct n-grams of a block in the order in which it asks for them.

    `use[k]`: for every token of the block, in order, the number of its n-gram with a context of k words (-1: none).
    `suffix`: for every n-gram the one whose context lacks the first word. `length`: of every context.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, buckets: int, hot: np.ndarray, order: int):
        super().__init__(hashes, bounds)
        n = self.tokens.size
        longer = list(_longer(self.before, self.at, order))
        held = [np.arange(n), *[h for _, h, _ in longer]]
        self.vocabulary, ids = np.unique(np.concatenate([self.tokens, self.before, *[c for _, _, c in longer]]), return_inverse=True)
        size = np.int64(self.vocabulary.size)
        self.token = ids[:n]
        contexts = np.split(ids[n:], np.cumsum([h.size for h in held])[:-1])
        self.length = np.ones(size, np.uint8)
        for k, context in enumerate(contexts, 1):
            self.length[context] = k
        pairs, use = np.unique(np.concatenate([c * size + self.token[h] for c, h in zip(contexts, held, strict=True)]), return_inverse=True)
        first, second = pairs // size, pairs % size
        place = self.vocabulary[first] % U64(buckets)
        spread = np.isin(self.vocabulary, hot)[first]
        place[spread] = mix64(self.vocabulary[first[spread]] ^ mix64(self.vocabulary[second[spread]])) % U64(buckets)
        order_of = np.argsort(place, kind="stable")
        back = np.empty_like(order_of)
        back[order_of] = np.arange(order_of.size)
        parts = np.split(back[use], np.cumsum([h.size for h in held])[:-1])
        self.use = {1: parts[0]}
        self.suffix = np.full(pairs.size if longer else 0, -1)
        for k, part in enumerate(parts[1:], 2):
            self.use[k] = np.full(n, -1)
            self.use[k][held[k - 1]] = part
            self.suffix[part] = self.use[k - 1][held[k - 1]]
        self.first, self.second = first[order_of], second[order_of]
        self.cuts = np.searchsorted(place[order_of], np.arange(buckets + 1).astype(U64))
        del self.tokens, self.before, self.at  # from here on tokens are numbers of the vocabulary

    def counts(self, trains: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the texts that train."""
        trains = trains[self.doc]
        return sum(np.bincount(use[trains & (use >= 0)], minlength=self.first.size) for use in self.use.values()).astype(np.uint32)

    def bucket(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context numbers of a bucket with the lengths of their runs, and the second words."""
        first = self.first[self.cuts[b]: self.cuts[b + 1]]
        change = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if first.size else np.zeros(0, int)
        runs = np.diff(np.concatenate([change, [first.size]]))
        return first[change], runs, self.second[self.cuts[b]: self.cuts[b + 1]]


def _asking(buckets: int, hot: np.ndarray, order: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("block", "train", "offsets", "payload")}
                hashes, bounds = _tokens(row["payload"].as_py(), row["offsets"].values.to_numpy())
                asked = _Grams(hashes, bounds, buckets, hot, order)
                counts = asked.counts(row["train"].values.to_numpy(zero_copy_only=False))
                for b in range(buckets):
                    words, runs, nexts = asked.bucket(b)
                    if not words.size:
                        continue
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b], pa.int32()), "block": [row["block"].as_py()],
                        "words": [asked.vocabulary[words].tobytes()], "lengths": [_pack(asked.length[words])], "runs": [_pack(runs.astype(np.uint32))],
                        "nexts": [asked.vocabulary[nexts].tobytes()],
                        "counts": [_pack(counts[asked.cuts[b]: asked.cuts[b + 1]])]})
    return ask


def _answering(hot: np.ndarray, order: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [np.frombuffer(r["words"], U64) for r in rows]
        runs = [_unpack(r["runs"], np.uint32) for r in rows]
        nexts = [np.frombuffer(r["nexts"], U64) for r in rows]
        vocabulary, word = np.unique(np.concatenate(words), return_inverse=True)
        length = np.zeros(vocabulary.size, np.uint8)
        length[word] = np.concatenate([_unpack(r["lengths"], np.uint8) for r in rows])
        first = np.repeat(word, np.concatenate(runs))
        seconds, second = np.unique(np.concatenate(nexts), return_inverse=True)
        pairs, pair = np.unique(first * np.int64(seconds.size) + second, return_inverse=True)
        counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows])
        totals = np.bincount(pair, weights=counts, minlength=pairs.size).astype(np.int64)
        of = pairs // seconds.size
        total = np.bincount(of, weights=totals, minlength=vocabulary.size).astype(np.int64)
        kinds = np.bincount(of[totals > 0], minlength=vocabulary.size)
        spread = np.isin(vocabulary, hot)
        once = lambda x, n: int((x == n).sum())
        own = total[~spread & (vocabulary != START) & (length == 1)]
        by_length = [totals[length[of] == k] for k in range(1, order)]
        starts = int(total[vocabulary == START].sum())
        stats = np.array([once(own, 1), once(own, 2), own.sum(), (own > 0).sum(), starts,
                          *[once(x, 1) for x in by_length], *[once(x, 2) for x in by_length]], np.int64)
        partial = np.concatenate([vocabulary[spread].view(np.int64), total[spread], kinds[spread]])
        out, at, at_word = [], 0, 0
        for i, r in enumerate(rows):
            mine, pick = pair[at: at + nexts[i].size], word[at_word: at_word + words[i].size]
            at, at_word = at + nexts[i].size, at_word + words[i].size
            out.append({"block": r["block"], "bucket": r["bucket"], "totals": _pack_totals(totals[mine]),
                        "words": _pack(total[pick]), "kinds": _pack(kinds[pick].astype(np.int64)),
                        "stats": np.concatenate([stats, partial]).tobytes() if i == 0 else None})
        return pa.Table.from_pylist(out, schema=_ANSWERS)
    return answer


_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("words", pa.binary()),
                      ("kinds", pa.binary()), ("stats", pa.binary())])


class Weights:
    """Corpus totals: discounts, token and word counts, and the totals of hot contexts."""

    def __init__(self, stats: list[bytes], hot: np.ndarray, hot_length: np.ndarray, order: int):
        self.order, plain = order, 5 + 2 * (order - 1)
        totals = np.zeros(plain, np.int64)
        self.hot = hot
        self.hot_total = np.zeros(hot.size, np.int64)
        self.hot_kinds = np.zeros(hot.size, np.int64)
        for raw in stats:
            row = np.frombuffer(raw, np.int64)
            totals += row[:plain]
            word, total, kinds = np.split(row[plain:], 3)
            at = np.searchsorted(self.hot, word.view(U64))
            self.hot_total[at] += total
            self.hot_kinds[at] += kinds
        one1, one2, n, v, docs = (int(x) for x in totals[:5])
        hot_words = self.hot_total[(self.hot != START) & (hot_length == 1)]
        one1, one2 = one1 + int((hot_words == 1).sum()), one2 + int((hot_words == 2).sum())
        self.docs = docs + int(self.hot_total[self.hot == START].sum())
        self.tokens = n + int(hot_words.sum()) + self.docs
        self.words = v + int((hot_words > 0).sum()) + (self.docs > 0)
        self.word_discount = self.discount(one1, one2)
        #: By the length of the context; none at 0.
        self.discounts = np.array([0.0, *[self.discount(int(a), int(b)) for a, b in zip(*np.split(totals[5:], 2), strict=True)]])

    @staticmethod
    def discount(once: int, twice: int) -> float:
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Automaton:
    """The states and arcs of the model that one block's texts can reach."""

    def __init__(self, asked: _Grams, buckets: int, answers: dict[int, dict], model: Weights):
        size = asked.vocabulary.size
        total, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        seen = np.zeros(asked.first.size, np.int64)
        for b in range(buckets):
            words, _, nexts = asked.bucket(b)
            if words.size:
                total[words] = _unpack(answers[b]["words"], np.int64)
                kinds[words] = _unpack(answers[b]["kinds"], np.int64)
                seen[asked.cuts[b]: asked.cuts[b + 1]] = _unpack_totals(answers[b]["totals"])
        at = np.minimum(np.searchsorted(model.hot, asked.vocabulary), max(model.hot.size - 1, 0))
        if model.hot.size:
            spread = model.hot[at] == asked.vocabulary
            total[spread], kinds[spread] = model.hot_total[at[spread]], model.hot_kinds[at[spread]]
        as_word = np.where(asked.vocabulary == END, model.docs, np.where(asked.vocabulary == START, 0, total))
        n, v, d1 = model.tokens, model.words, model.word_discount
        discount = model.discounts[asked.length]
        self.order, self.count, self.state = model.order, as_word, total > 0
        self.base = np.log10((as_word + 0.5) / (n + 0.5 * (v + 1)))
        root = np.where(as_word > 0, as_word - d1, d1 * v) / n if n else np.ones(size)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(self.state, discount * kinds / total, 1.0)
            arc = (seen - discount[asked.first]) / total[asked.first]
            arc += left[asked.first] * root[asked.second] if self.order == 2 else self._below(asked, arc, seen, left, root)
            self.root, self.failure = np.log10(root), np.log10(left)
            self.arc = np.where(seen > 0, np.log10(arc), np.nan)

    def _below(self, asked: _Grams, own: np.ndarray, seen: np.ndarray, left: np.ndarray, root: np.ndarray) -> np.ndarray:
        """What each n-gram gets from the contexts without its first word, shortest contexts first."""
        below = np.empty(own.size)
        for k in range(1, self.order):
            gram = np.flatnonzero(asked.length[asked.first] == k)
            suffix = asked.suffix[gram]
            lower = root[asked.second[gram]] if k == 1 else below[suffix] + np.where(seen[suffix] > 0, own[suffix], 0.0)
            below[gram] = left[asked.first[gram]] * lower
        return below

    def walk(self, asked: _Grams, lane: int) -> np.ndarray:
        """log10 probability of every text: one traversal from left to right, all lanes of `lane` tokens side by side."""
        longest = self.order - 1
        lanes = -(-(asked.ends - asked.starts) // lane)
        doc = np.repeat(np.arange(lanes.size), lanes)
        number = np.arange(doc.size) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = asked.starts[doc] + number * lane
        begin = np.maximum(own - longest, asked.starts[doc])
        size = np.minimum(own + lane, asked.ends[doc]) - begin
        by_size = np.argsort(-size, kind="stable")
        doc, begin, own, size = doc[by_size], begin[by_size], own[by_size], size[by_size]
        # a text begins in the state of its start, a later lane in the root
        depth = np.where(begin == asked.starts[doc], self.settled(asked, begin, np.ones(doc.size, np.int64)), 0)
        score = np.zeros(doc.size)
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -step, side="left"))
            at = begin[:active] + step
            weight, level = self.step(asked, at, depth[:active])
            score[:active] += np.where(at >= own[:active], weight, 0.0)
            moving = int(np.searchsorted(-size, -step - 1, side="left"))
            depth[:moving] = self.settled(asked, at[:moving] + 1, np.minimum(level[:moving] + 1, longest))
        return np.bincount(doc, weights=score, minlength=lanes.size)

    def step(self, asked: _Grams, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of reading the tokens `at` in states of `depth` words, and the depth at which each had its arc."""
        weight, level = np.zeros(at.size), depth.copy()
        for k in range(self.order - 1, 0, -1):
            here = np.flatnonzero(level == k)
            gram = asked.use[k][at[here]]
            arc = self.arc[gram]
            fails = np.isnan(arc)
            weight[here] += np.where(fails, self.failure[asked.first[gram]], arc)
            level[here[fails]] = k - 1
            level[here[~fails]] += self.order  # read; out of the way of shorter contexts
        at_root = level == 0
        weight[at_root] += self.root[asked.token[at[at_root]]]
        return weight, level % self.order

    def settled(self, asked: _Grams, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Depth of the longest context before the tokens `at`, of `depth` words or fewer, that is a state."""
        depth = depth.copy()
        for k in range(self.order - 1, 0, -1):
            here = np.flatnonzero(depth == k)
            none = ~self.state[asked.first[asked.use[k][at[here]]]]
            depth[here[none]] = k - 1
        return depth


def _scoring(buckets: int, model: Weights) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, bounds = _tokens(batch.column("payload")[i].as_py(), batch.column("offsets")[i].values.to_numpy())
                asked = _Grams(hashes, bounds, buckets, model.hot, model.order)
                answers = {a["bucket"]: a for a in batch.column("answers")[i].as_py()}
                automaton = Automaton(asked, buckets, answers, model)
                n = bounds.size - 1
                total = lambda x: np.bincount(asked.doc, weights=x, minlength=n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_ids")[i].values,
                    "held_out": [not t for t in batch.column("train")[i].as_py()],
                    "n_tokens": pa.array(np.diff(bounds) + 1, pa.int64()),
                    "n_known": pa.array(total(automaton.count[asked.token] > 0).astype(np.int64)),
                    "train_tokens": pa.array(np.full(n, model.tokens, np.int64)),
                    "base_score": total(automaton.base[asked.token]), "score": automaton.walk(asked, LANE)})
    return score


def score_texts(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out (not `train`), token counts, unigram base score and the model's log10 probability.
    `order`: the longest n-grams of the model, 2 or more."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(docs.select(F.col("doc_id").cast("long"), F.coalesce(train, F.lit(True)).alias("train"),
                                F.coalesce("text", F.lit("")).alias("text"))
                    .mapInArrow(_packing(order), BLOCKS), "lm-blocks")
    hot, hot_length = _hot_contexts(blocks)
    answers = stored(blocks.select("block", "train", "offsets", "payload").mapInArrow(_asking(buckets, hot, order), ASKS)
                     .groupBy("bucket").applyInArrow(_answering(hot, order), ANSWERS), "lm-answers")
    model = Weights([r.stats for r in answers.filter("stats IS NOT NULL").select("stats").collect()], hot, hot_length, order)
    per_block = answers.groupBy("block").agg(
        F.collect_list(F.struct("bucket", "totals", "words", "kinds")).alias("answers"))
    return (blocks.select("block", "doc_ids", "train", "offsets", "payload").join(per_block, "block")
            .select("doc_ids", "train", "offsets", "payload", "answers")
            .mapInArrow(_scoring(buckets, model), SCORES))


def _hot_contexts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, with their lengths, that hold over 1/HOT of the corpus in the blocks' own lists; at most HOT of each length."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words, lengths, counts = (np.frombuffer(x, np.int64) for x in lists)
                yield pa.RecordBatch.from_pydict({"word": words, "length": lengths, "n": counts})

    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    found = (blocks.select("hot_words", "hot_lengths", "hot_counts").mapInArrow(listed, "word long, length long, n long")
             .groupBy("word", "length").agg(F.sum("n").alias("n")).filter(F.col("n") * HOT > total).select("word", "length").collect())
    words = np.array([r.word for r in found], np.int64).view(U64)
    order = np.argsort(words)
    return words[order], np.array([r.length for r in found], np.int64)[order]
