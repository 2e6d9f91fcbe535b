"""N-gram Jaccard join with parity sketches.

A text's set holds the hashes of its distinct runs of WIDTH words. Texts with equal sets are one
class; everything below works on classes.

Sketch: every shingle flips one bit of a long bit string, so the sketches of two sets
differ in at most |A xor B| bits. The string is cut into chunks: for a set of 2**e to
2**(e+1) - 1 shingles (its size band) 2**e chunks of 2**32 bits, for sets under DENSE shingles chunks of a
single bit. Two sets with similarity 0.75 and sizes a, b differ in at most (a + b) / 7 shingles, hence in at most as
many chunks; so among a set's non-empty chunks, taken in one order for all sets, the
first d + 1 + s (d: the most that can differ) hold s + 1 that the other set has too, in its
own first ones. A set meets larger sets of the next band under that band's chunks as well. Chunks are joined by the
hash of their odd bits.

Chunks of up to GROUP classes give all their pairs; a pair stays a candidate if it has met in as many chunks as a
linked pair must share, frequent ones aside, so a passage that two texts share is not enough. More frequent chunks
give no pairs, and a class is settled if fewer of its chunks are frequent than it must share with any partner. The pairs among unsettled classes are found by the same join over
all their shingles, where a class is settled unless three quarters of its shingles are frequent among unsettled classes. What is left
are crowds of near copies: there each class is compared with the most central class of each of its
groups (the one with the largest share of frequent shingles, as the text that the others are copies of), and
after joining what links, all pairs of group members that are still in different
components and whose dense sketches differ in no more bits than their sizes allow. No pair is dropped anywhere.

Every candidate pair is verified on the sets themselves (64-bit shingle hashes).

Defined cases: null or empty texts, and texts without words, have an empty set and link with nothing; a text of fewer
than WIDTH words has its whole sequence as one shingle; a null doc_id takes part but
never names a component (null if all of its ids are null); repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.components import components
from kontor.llm.scratch import drop, stored
from kontor.llm.words import U64, Texts, mix64, per_text, shingles, text_slices

WIDTH = 5
#: Texts hashed at once; a dozen arrays of 8 bytes a byte are alive meanwhile.
SLICE_BYTES = 512 << 10
GROUP = 64
DENSE = 1024
FILTER_BITS = 23
SKETCH_BITS = 1024

BLOBS = "bucket int, keys binary, owners binary, classes binary, sizes binary"
#: A pair of classes with the keys it has met in and those a linked pair must share, or (b null) a class with its frequent keys.
FOUND = "a long, b long, times long, need long"


class Sets:
    """Distinct shingles of the texts of a slice, sorted inside each text, with class numbers."""

    def __init__(self, texts: Texts, width: int = WIDTH):
        start, end, text = texts.words()
        runs, of = shingles(texts.hashes(start, end), per_text(text, texts.n), width)
        order = np.lexsort((runs, of))
        runs, of = runs[order], of[order]
        new = np.ones(runs.size, bool)
        new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
        self.items, self.of = runs[new], of[new]
        self.bounds = per_text(self.of, texts.n)
        self.sizes = np.diff(self.bounds)
        one, two = mix64(self.items), mix64(self.items ^ U64(0x9E3779B97F4A7C15))
        total = lambda x: np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x)])[self.bounds])
        self.classes = mix64(total(one) ^ mix64(total(two) + self.sizes.astype(U64))).view(np.int64)

    def only(self, keep: np.ndarray) -> Sets:
        """The same with the texts that `keep` marks."""
        out = object.__new__(Sets)
        inside = keep[self.of]
        out.items = self.items[inside]
        out.of = (np.cumsum(keep) - 1)[self.of[inside]]
        out.sizes, out.classes = self.sizes[keep], self.classes[keep]
        out.bounds = np.concatenate([[0], np.cumsum(out.sizes)])
        return out


class Wanted:
    """Bits of some classes and of the ids of documents that stand for them; a filter of fixed size that lets these pass."""

    def __init__(self, classes: DataFrame, first: DataFrame):
        numbers = (classes.select("cls").join(first.select("cls", "first_doc"), "cls")
                   .select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("cls").alias("x")),
                                             F.struct(F.lit(1).alias("kind"), F.col("first_doc").alias("x")))).alias("r")).select("r.*"))
        place = F.pmod("x", F.lit(1 << FILTER_BITS)) + 1
        rows = (numbers.dropna().groupBy("kind", F.bitmap_bucket_number(place).alias("k"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())
        self.classes, self.docs = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool)
        for r in rows:
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").astype(bool)
            at = slice((r.k - 1) * 32768, r.k * 32768)
            (self.docs if r.kind else self.classes)[at] = bits

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows that may stand for a class; a null id always may."""
        ids = batch.column(0)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        keep = self.docs[known & ((1 << FILTER_BITS) - 1)] | ids.is_null().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(keep))


def fresh_sets(batches: Iterator[pa.RecordBatch], wanted: Wanted | None = None) -> Iterator[Sets]:
    """Sets of the texts of (doc_id, text) rows, of every class the first that this task meets (copies need no second sketch)."""
    seen: set[int] = set()
    for batch in batches:
        if wanted is not None:
            batch = wanted.rows(batch)
        for texts in text_slices(batch.column(1), SLICE_BYTES):
            sets = Sets(texts)
            keep = sets.sizes > 0
            if wanted is not None:
                keep &= wanted.classes[sets.classes & ((1 << FILTER_BITS) - 1)]
            for i in np.flatnonzero(keep).tolist():
                name = int(sets.classes[i])
                keep[i] = name not in seen
                seen.add(name)
            if keep.any():
                yield sets.only(keep)


def chunk_keys(items: np.ndarray, of: np.ndarray, sizes: np.ndarray, band: np.ndarray, limit: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the first `limit` non-empty chunks of each set under its `band`, and their owners.

    band 0: chunks of one bit; else 2**band chunks. Raises if a set has too few non-empty chunks
    for its limit, which for sets in their band has a chance below 1e-15.
    """
    flip = mix64(items ^ U64(0x632BE59BD9B4E019))
    b = band[of].astype(U64)
    bit = flip & U64(0xFFFFFFFF)
    chunk = np.where(b == 0, U64(0), (flip >> U64(32)) >> (U64(32) - b))
    digest = mix64(bit + U64(1))
    dense = b == 0
    key = np.empty_like(flip)
    owner = of.copy()
    key[dense] = mix64(flip[dense])
    if not dense.all():
        at = np.flatnonzero(~dense)
        order = at[np.lexsort((chunk[at], of[at]))]
        edge = np.flatnonzero(np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (chunk[order][1:] != chunk[order][:-1])]))
        odd = np.bitwise_xor.reduceat(digest[order], edge)
        head = order[edge]
        full = odd != 0
        name = mix64(odd[full] ^ mix64(chunk[head[full]] + (b[head[full]] << U64(40))))
        key = np.concatenate([key[dense], name])
        owner = np.concatenate([of[dense], of[head[full]]])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    bounds = per_text(owner, sizes.size)
    if (np.diff(bounds) < limit).any():
        raise ValueError("a sketch has too few non-empty chunks")
    first = np.arange(key.size) - bounds[:-1][owner] < limit[owner]
    return key[first], owner[first]


def _first_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and sizes for the join of all classes: own band, and the next for sets that may meet it."""
    n = sets.sizes
    top = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    out = []
    for up in (0, 1):
        band = np.where(n >= DENSE, top, 0) if up == 0 else top + 1
        use = n > 0 if up == 0 else (4 * n >= 3 * (2 << top)) & ((2 << top) >= DENSE)
        some = sets.only(use)
        band = band[use]
        size = some.sizes
        limit = np.where(band == 0, size // 4, size // 3) + 1 + size // 16
        key, owner = chunk_keys(some.items, some.of, size, band, limit)
        out.append((key, np.flatnonzero(use)[owner]))
    return np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]]), n


def _all_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys for the join of unsettled classes: every shingle."""
    key, owner = chunk_keys(sets.items, sets.of, sets.sizes, np.zeros(sets.sizes.size, np.int64), sets.sizes)
    return key, owner, sets.sizes


def _least_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys for the join of crowds: the first quarter and one, of which a linked pair shares one at least."""
    key, owner = chunk_keys(sets.items, sets.of, sets.sizes, np.zeros(sets.sizes.size, np.int64), sets.sizes // 4 + 1)
    return key, owner, sets.sizes


def _sketching(buckets: int, keys: Callable, wanted: Wanted | None) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in fresh_sets(batches, wanted):
            key, owner, sizes = keys(sets)
            bucket = (key >> U64(32)) % U64(buckets)
            order = np.lexsort((owner, bucket))
            key, owner, bucket = key[order], owner[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1).astype(U64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                at = slice(cut[b], cut[b + 1])
                mine, local = np.unique(owner[at], return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b], pa.int32()), "keys": [key[at].tobytes()],
                    "owners": [local.astype(np.uint32).tobytes()],
                    "classes": [sets.classes[mine].tobytes()], "sizes": [sizes[mine].astype(np.int32).tobytes()]})
    return sketch


class Groups:
    """Classes that share a key, over a bucket; of copies of a class one stays."""

    def __init__(self, table: pa.Table):
        keys, classes, sizes = [], [], []
        for k, o, c, s in zip(*(table.column(x).to_pylist() for x in ("keys", "owners", "classes", "sizes")), strict=True):
            owner = np.frombuffer(o, np.uint32)
            keys.append(np.frombuffer(k, U64))
            classes.append(np.frombuffer(c, np.int64)[owner])
            sizes.append(np.frombuffer(s, np.int32)[owner])
        key, name, size = np.concatenate(keys), np.concatenate(classes), np.concatenate(sizes)
        order = np.lexsort((name, key))
        key, name, size = key[order], name[order], size[order]
        new = np.ones(key.size, bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        self.key, self.name, self.size = key[new], name[new], size[new].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]))
        self.count = np.diff(np.concatenate([begin, [self.key.size]]))
        self.begin = begin
        self.group = np.repeat(np.arange(begin.size), self.count)


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes that allow a similarity of 0.75."""
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def _found(a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray,
           frequent: np.ndarray | None = None, often: np.ndarray | None = None) -> pa.Table:
    n, m = a.size, 0 if frequent is None else frequent.size
    blank = np.arange(n + m) >= n
    extra = frequent if m else np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([a, extra]), "b": pa.array(np.concatenate([b, extra]), mask=blank),
                     "times": np.concatenate([times, often if m else extra]).astype(np.int64),
                     "need": np.concatenate([need, np.zeros(m, np.int64)]).astype(np.int64)})


def _pairs(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs with how often each came, and what it needs."""
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if a.size else np.zeros(0, int)
    return a[first], b[first], np.diff(np.concatenate([first, [a.size]])), need[first]


def first_need(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Keys that a linked pair of these sizes shares among the first ones of both."""
    return 1 + low // 16


def all_need(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Shingles that a linked pair of these sizes shares."""
    return -(-3 * high // 4)


def _pairing(group_limit: int, need: Callable) -> Callable:
    """All fitting pairs of groups up to the limit; for larger ones how many each class is in."""
    def pair(table: pa.Table) -> pa.Table:
        g = Groups(table)
        small = np.where(g.count <= group_limit, g.count, 0)
        at = np.flatnonzero((small > 1)[g.group])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, int(small.max(initial=0))):
            at = at[at + step < (g.begin + g.count)[g.group[at]]]
            ok = fits(g.size[at], g.size[at + step])
            left.append(at[ok])
            right.append(at[ok] + step)
        x, y = np.concatenate(left), np.concatenate(right)
        low, high = np.minimum(g.size[x], g.size[y]), np.maximum(g.size[x], g.size[y])
        name, often = np.unique(g.name[(g.count > group_limit)[g.group]], return_counts=True)
        return _found(*_pairs(g.name[x], g.name[y], need(low, high)), name, often)
    return pair


def parity_sketch(items: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Dense sketches (n, SKETCH_BITS // 8 bytes): every shingle flips one bit."""
    place = of * SKETCH_BITS + (mix64(items ^ U64(0xD6E8FEB86659FD93)) % U64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS).astype(np.uint8), axis=1)


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint16)


def _across(table: pa.Table) -> pa.Table:
    """Pairs of a group's classes in different components that fit in size and sketch. Rows: key, cls, size, sketch, root."""
    key, name, size, root = (table.column(c).to_numpy() for c in ("key", "cls", "size", "root"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(key.size, -1)
    order = np.lexsort((name, root, key))
    key, name, size, root, sketch = key[order], name[order], size[order], root[order], sketch[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    held = 0
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), key.size], strict=True):
        if root[a] == root[b - 1]:
            continue
        part = np.flatnonzero(np.concatenate([[True], root[a + 1: b] != root[a: b - 1]])) + a
        for s, e in zip(part.tolist(), [*part[1:].tolist(), b], strict=True):
            for i in range(s, e if e < b else s):  # one class against all of later components
                at = np.flatnonzero(fits(size[e:b], size[i])) + e
                differ = _ONES[sketch[at] ^ sketch[i]].sum(axis=1)
                at = at[7 * differ <= size[at] + size[i]]
                if at.size:
                    found.append(np.stack([np.minimum(name[at], name[i]), np.maximum(name[at], name[i])], 1))
                    held += at.size
            if held > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and class (null for an empty set) of every document."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(1), SLICE_BYTES):
                sets = Sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, texts.n), pa.array(sets.sizes, pa.int64()),
                     pa.array(sets.classes, mask=sets.sizes == 0)], names=["doc_id", "n_shingles", "cls"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(profile, "doc_id long, n_shingles long, cls long")


def class_sets(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """(cls, items): the sorted shingle hashes of the wanted classes."""
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in fresh_sets(batches, wanted):
            yield pa.RecordBatch.from_pydict({"cls": sets.classes, "items": [
                sets.items[a:b].tobytes() for a, b in zip(sets.bounds[:-1].tolist(), sets.bounds[1:].tolist(), strict=True)]})

    return docs.mapInArrow(sets_of, "cls long, items binary").groupBy("cls").agg(F.first("items").alias("items"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(x[i].as_buffer(), U64) for x in (left, right))
            both = np.intersect1d(a, b, assume_unique=True).size
            keep[i] = 100 * both >= 75 * (a.size + b.size - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity; pairs: distinct (a, b) of class numbers, written."""
    names = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = stored(class_sets(docs, Wanted(names, classes)), "jaccard-sets")
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("right"))
    links = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_linked, "a long, b long"),
                   "jaccard-links")
    drop(docs.sparkSession, sets)
    return links


def _joined(docs: DataFrame, keys: Callable, how: Callable, wanted: Wanted | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs, and the classes with frequent keys and how many."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(docs.mapInArrow(_sketching(buckets, keys, wanted), BLOBS).groupBy("bucket").applyInArrow(how, FOUND), "jaccard-found")
    often = stored(found.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("times").alias("often")), "jaccard-frequent")
    met = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("times").alias("times"), F.first("need").alias("need"))
    for side in ("a", "b"):
        met = met.join(often.select(F.col("cls").alias(side), F.col("often").alias(f"often_{side}")), side, "left")
    shared = F.col("times") + F.least(F.coalesce("often_a", F.lit(0)), F.coalesce("often_b", F.lit(0)))
    pairs = stored(met.filter(shared >= F.col("need")).select("a", "b"), "jaccard-pairs")
    drop(docs.sparkSession, found)
    return pairs, often


def class_links(docs: DataFrame, classes: DataFrame, group_limit: int = GROUP) -> DataFrame:
    """All links (a, b) that components need between the classes (cls, first_doc, size)."""
    sizes = classes.select("cls", "size")
    pairs, often = _joined(docs, _first_keys, _pairing(group_limit, first_need))
    least = F.ceil(F.col("size") * 3 / 4)  # the smallest partner shares 1 + a sixteenth of its own size
    rest = stored(often.join(sizes, "cls").filter(F.col("often") >= 1 + F.floor(least / 16)).select("cls"), "jaccard-unsettled")
    members = None
    if not rest.isEmpty():
        more, often = _joined(docs, _all_keys, _pairing(group_limit, all_need), Wanted(rest, classes))
        pairs = pairs.union(more)
        crowd = stored(often.join(sizes, "cls").filter(F.col("often") >= least)
                       .select("cls", (F.col("often") / F.col("size")).alias("share")), "jaccard-crowd")
        if not crowd.isEmpty():
            members = _members(docs, crowd, Wanted(crowd, classes))
            pairs = pairs.union(_stars(members))
    links = verified(docs, classes, stored(pairs.distinct(), "jaccard-pairs"))
    if members is None:
        return links
    across = _open_pairs(members, links)
    return links if across.isEmpty() else links.union(verified(docs, classes, across))


def _members(docs: DataFrame, crowd: DataFrame, wanted: Wanted) -> DataFrame:
    """(key, cls, size, sketch, share) of the crowd's classes, a row for each of their least keys."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in fresh_sets(batches, wanted):
            key, owner, sizes = _least_keys(sets)
            dense = [row.tobytes() for row in parity_sketch(sets.items, sets.of, sizes.size)]
            bounds = per_text(owner, sizes.size)
            yield pa.RecordBatch.from_pydict({
                "cls": sets.classes, "size": sizes, "sketch": dense,
                "keys": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key.view(np.int64)))})

    rows = docs.mapInArrow(keyed, "cls long, size long, sketch binary, keys array<long>").dropDuplicates(["cls"])
    return stored(rows.join(crowd, "cls").select(F.explode("keys").alias("key"), "cls", "size", "sketch", "share"), "jaccard-members")


def _stars(members: DataFrame) -> DataFrame:
    """Each member of a group with the group's most central class."""
    rank = F.struct("share", "size", "cls")
    pivot = members.groupBy("key").agg(F.max_by(F.struct("cls", "size"), rank).alias("p"), F.count("*").alias("n")).filter("n > 1")
    met = (members.select("key", "cls", "size").join(pivot.select("key", F.col("p.cls").alias("pc"), F.col("p.size").alias("ps")), "key")
           .filter((F.col("cls") != F.col("pc")) & (4 * F.least("size", "ps") >= 3 * F.greatest("size", "ps"))))
    return met.select(F.least("cls", "pc").alias("a"), F.greatest("cls", "pc").alias("b")).distinct()


def _open_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of a group's members that the links so far leave in different components."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = (members.drop("share").join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("root", F.coalesce("root", "cls")))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    across = (rooted.join(open_keys, "key").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(parts)))
              .groupBy("bucket").applyInArrow(lambda t: _across(t), "a long, b long"))
    return stored(across.distinct(), "jaccard-pairs")


def near_duplicates(docs: DataFrame, group_limit: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = stored(profiles(docs), "jaccard-profiles")
    classes = stored(rows.filter("cls IS NOT NULL").groupBy("cls")
                     .agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("size")), "jaccard-classes")
    links = class_links(docs.select(F.col("doc_id").cast("long"), "text"), classes, group_limit)
    roots = components(links).withColumnRenamed("node", "cls")
    named = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    names = named.join(lowest, "root").select("cls", "component_id")
    return (rows.join(names, "cls", "left")
            .select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
