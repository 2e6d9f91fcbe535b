"""Statistics of all earlier rows of an account, its categories and merchants, before each row.

Rows are put in blocks that one task reads in order: whole accounts together in hashed blocks, and an account of more than
a block's rows (`hot`) in consecutive blocks of a range sort. Inside a block counts and sums are running sums over arrays, and only
medians take a step for each row; a hot account's block starts from what the blocks before it leave behind (its carry):

* row counts, sums and sums of squares in cents (exact decimals), the last date, and counts of days that reach into
  other blocks, by block-wise aggregates and running sums over them;
* for medians, the middle of the earlier blocks' values. A block of m rows can move the median by m/2 ranks at most, so
  the m + 4 middle values are enough. They are found by ranking the distinct values once, cutting them into chunks, and
  counting earlier values by chunk: only the values of chunks around the middle are sent to a block.

Work is n log n for rows in all; counts by chunk and block are the square of an account's number of blocks.
"""

from __future__ import annotations

import itertools
import math
from bisect import insort
from heapq import heapify, heappush, heappushpop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions.scan import keyed_running
from kontor.session import cut_lineage

BLOCK_ROWS = 200_000
MOST_HOT = 100_000  # more accounts than that over a block's rows: blocks grow
SALTS = 8
SORTED_ROWS = 4096  # so many values are kept as one sorted list for their median; two heaps beyond
EXACT = 2**62  # sums below fit 64 bits

STATS = ("_c_mean double, _c_std double, _c_med double, _c_cnt long, _a_mean double, _a_std double, _a_med double, _a_cnt long, "
         "_m_cnt long, _prev_date date, _m_day long, _a_day long")
CARRY = "_pid long, kind string, _key string, name string, day date, n long, s1 decimal(38,0), s2 decimal(38,0), cents long, below long"


class Middle:
    """The two values around the median of those added so far."""

    __slots__ = ("n", "low", "high")

    def __init__(self):
        self.n = 0
        self.low, self.high = [], []  # halves around the median: a heap of negatives, a heap

    def carried(self, n: int, cents: np.ndarray, counts: np.ndarray, below: int, reach: int) -> None:
        """n values before, of them those around their median; `below` are smaller. Only `reach` on each side can be met."""
        order = np.argsort(cents)
        cents, counts = cents[order], counts[order]
        end = below + np.cumsum(counts)
        half = (n + 1) // 2

        def between(a: int, b: int) -> list[int]:
            return np.repeat(cents, np.maximum(np.minimum(end, b) - np.maximum(end - counts, a), 0)).tolist()

        self.n, self.low, self.high = n, [-x for x in between(half - reach, half)], between(half, half + reach)
        heapify(self.low)
        heapify(self.high)

    def before(self, values: list[int], low: list[int], high: list[int]) -> None:
        """Both values before each of `values` is added, 0 where there are none."""
        for x in values:
            low.append(-self.low[0] if self.n else 0)
            high.append(low[-1] if self.n & 1 or not self.n else self.high[0])
            if self.n & 1:
                heappush(self.high, -heappushpop(self.low, -x))
            else:
                heappush(self.low, -heappushpop(self.high, x))
            self.n += 1


def _middles_before(values: np.ndarray, starts: np.ndarray, carried: dict[int, Middle]) -> np.ndarray:
    """For every value the two around the median of those before it in its group; `carried`: groups that begin with values."""
    low: list[int] = []
    high: list[int] = []
    every, bounds = values.tolist(), [*starts.tolist(), values.size]
    for g, (a, b) in enumerate(itertools.pairwise(bounds)):
        if g in carried or b - a > SORTED_ROWS:
            carried.get(g, Middle()).before(every[a:b], low, high)
            continue
        seen: list[int] = []
        for m, x in enumerate(every[a:b]):
            low.append(seen[(m - 1) >> 1] if m else 0)
            high.append(seen[m >> 1] if m else 0)
            insort(seen, x)
    return np.array([low, high], np.int64)


class Groups:
    """Rows of equal codes in the order they have; `keep`: their first rows' places."""

    def __init__(self, *codes: np.ndarray):
        code = codes[0].astype(np.int64)
        for c in codes[1:]:
            code = np.unique(code, return_inverse=True)[1] * (int(c.max(initial=0)) + 1) + c
        self.order = np.argsort(code, kind="stable")
        there = code[self.order]
        self.starts = np.flatnonzero(np.concatenate([np.ones(min(1, there.size), bool), there[1:] != there[:-1]]))
        self.sizes = np.diff(np.append(self.starts, there.size))
        self.of = np.repeat(np.arange(self.starts.size), self.sizes)  # in order, as `place`
        self.place = np.arange(there.size) - self.starts[self.of]
        self.first = self.order[self.starts]

    def back(self, ordered: np.ndarray) -> np.ndarray:
        """Values in the groups' order, by row."""
        out = np.empty_like(ordered)
        out[self.order] = ordered
        return out

    def carried(self, have: dict, names: list[list]) -> np.ndarray:
        """What `have` holds for each group's names (0: nothing), for its rows in order."""
        if not have:
            return np.zeros(self.of.size, np.int64)
        found = [have.get(tuple(n[i] for n in names), 0) for i in self.first.tolist()]
        return np.array(found, np.int64 if max(map(abs, found), default=0) < EXACT else object)[self.of]


def _moments(groups: Groups, cents: np.ndarray, sums: tuple[dict, dict, dict], middles: dict, names: list[list]) -> tuple:
    """Mean, deviation, median (NaN: none) and count of the earlier values of a row's group."""
    n0, s1, s2 = (groups.carried(have, names) for have in sums)
    x = cents[groups.order]
    top = int(np.abs(x).max(initial=0))
    if s2.dtype == object or s1.dtype == object or int(s2.max(initial=0)) + top * top * x.size >= EXACT:
        x, s1, s2 = x.astype(object), s1.astype(object), s2.astype(object)

    def earlier(values: np.ndarray) -> np.ndarray:
        upto = np.cumsum(values)
        return upto - values - (upto - values)[groups.starts][groups.of] if values.size else values

    n, s1, s2 = n0 + groups.place, s1 + earlier(x), s2 + earlier(x * x)
    mean, spread = np.full(n.size, np.nan), np.full(n.size, np.nan)
    # doubles hold these whole; the other rows take Python's integers
    small = (n.astype(float) * s2.astype(float) < 2**52) & (np.abs(s1.astype(float)) < 2**52)
    some, more = small & (n > 0), small & (n > 1)
    mean[some] = s1[some].astype(float) / 100 / n[some]
    k, a, b = n[more], s1[more].astype(np.int64), s2[more].astype(np.int64)
    spread[more] = np.sqrt((k * b - a * a) / (k * (k - 1))) / 100
    for i in np.flatnonzero(~small & (n > 0)).tolist():
        k, a, b = int(n[i]), int(s1[i]), int(s2[i])
        mean[i] = a / 100 / k
        if k > 1:
            spread[i] = math.sqrt((k * b - a * a) / (k * (k - 1))) / 100
    at = {}
    if middles:
        of_names = {tuple(name[i] for name in names): g for g, i in enumerate(groups.first.tolist())}
        for name, (values, counts, below) in middles.items():
            if name in of_names:
                g = of_names[name]
                at[g] = Middle()
                at[g].carried(sums[0][name], values, counts, below, int(groups.sizes[g]) + 2)
    low, high = _middles_before(cents[groups.order], groups.starts, at) / 100
    median = np.where(n > 0, low + (high - low) * 0.5, np.nan)  # interpolated as SQL's quantiles are
    return tuple(groups.back(v) for v in (mean, spread, median, n))


def _carried(carry: pa.Table | None) -> tuple[dict, dict]:
    """What a block starts from: by kind and names, the figures (n, s1, s2, day); the values around medians."""
    figures: dict = {kind: ({}, {}, {}, {}) for kind in ("a", "c", "m", "d", "md")}
    parts: dict = {"av": {}, "cv": {}}
    for r in carry.to_pylist() if carry is not None else []:
        kind, key = r["kind"], (r["_key"], r["name"])
        if kind in parts:
            parts[kind].setdefault(key if kind == "cv" else key[:1], []).append((r["cents"], r["n"], r["below"]))
            continue
        name = {"a": key[:1], "d": (r["_key"], r["day"]), "md": (*key, r["day"])}.get(kind, key)
        for have, value in zip(figures[kind], (r["n"], r["s1"], r["s2"], r["day"]), strict=True):
            have[name] = value if have is figures[kind][3] else int(value or 0)
    middles = {kind: {name: (of[:, 0], of[:, 1], int(of[0, 2])) for name, values in names.items() for of in [np.array(values, np.int64)]}
               for kind, names in parts.items()}
    return figures, middles


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers for equal values; null is one of them."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def block_stats(rows: pa.Table, carry: pa.Table | None = None) -> pa.Table:
    """The rows of one block in order, with STATS."""
    rows = rows.sort_by([("_key", "ascending"), ("_day", "ascending"), ("transaction_id", "ascending")])
    figures, middles = _carried(carry)
    key, category, shop, day = (_codes(rows.column(c)) for c in ("_key", "category", "merchant", "_day"))
    names = {c: rows.column(c).to_pylist() for c in ("_key", "category", "merchant", "posted_date")} if carry is not None else {}
    of = lambda *columns: [names[c] for c in columns] if names else []
    cents = rows.column("_cents").to_numpy()
    accounts, own, shops = Groups(key), Groups(key, category), Groups(key, shop)
    days, shop_days = Groups(key, day), Groups(key, shop, day)
    out = [*_moments(own, cents, figures["c"][:3], middles["cv"], of("_key", "category")),
           *_moments(accounts, cents, figures["a"][:3], middles["av"], of("_key")),
           shops.back(shops.place + shops.carried(figures["m"][0], of("_key", "merchant")))]
    # the date of the row before; an account's first row takes what is carried
    dates = rows.column("posted_date")
    last = [figures["a"][3].get((names["_key"][i],)) if names else None for i in accounts.first.tolist()]
    pool = pa.concat_arrays([*dates.chunks, pa.array(last, dates.type)])
    at = accounts.back(np.where(accounts.place > 0, np.concatenate([[0], accounts.order[:-1]])[:accounts.order.size], len(dates) + accounts.of))
    out += [pool.take(pa.array(at)).cast(pa.date32()),
            shop_days.back(shop_days.sizes[shop_days.of] + shop_days.carried(figures["md"][0], of("_key", "merchant", "posted_date"))),
            days.back(days.sizes[days.of] + days.carried(figures["d"][0], of("_key", "posted_date")))]
    fields = [p.split() for p in STATS.split(", ")]
    for (name, kind), values in zip(fields, out, strict=True):
        if kind != "date":
            values = pa.array(values, pa.float64(), from_pandas=True) if kind == "double" else pa.array(values, pa.int64())
        rows = rows.append_column(name, values)
    return rows


def _left_behind(rows: DataFrame) -> DataFrame:
    """What each block of hot rows (with _pid, its number in order) finds from the blocks before it: CARRY rows."""
    square = F.col("_cents").cast("decimal(19,0)") * F.col("_cents").cast("decimal(19,0)")
    fields = [f.name for f in T.StructType.fromDDL(CARRY).fields]

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        have = set(df.columns)
        ddl = T.StructType.fromDDL(CARRY)
        return df.withColumn("kind", F.lit(kind)).select(*[(F.col(f) if f in have or f == "kind" else F.lit(None)).cast(ddl[f].dataType).alias(f) for f in fields])

    def before(keys: list[str], name: str | None, kind: str) -> DataFrame:
        per = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_cents").cast("decimal(19,0)")).alias("s1"),
                                              F.sum(square).alias("s2"), F.max("posted_date").alias("day"))
        w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        sums = per.select(*keys, "_pid", *[F.sum(c).over(w).alias(c) for c in ("n", "s1", "s2")], F.max("day").over(w).alias("day"))
        return shaped(sums.filter("n > 0").withColumn("name", F.col(name) if name else F.lit(None).cast("string")), kind)

    def days(keys: list[str], name: str | None, kind: str) -> DataFrame:
        per = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("own"))
        others = per.withColumn("n", F.sum("own").over(Window.partitionBy(*keys)) - F.col("own")).filter("n > 0")
        return shaped(others.select("_key", "_pid", "n", F.col("posted_date").alias("day"),
                                    (F.col(name) if name else F.lit(None).cast("string")).alias("name")), kind)

    parts = [before(["_key"], None, "a"), before(["_key", "category"], "category", "c"), before(["_key", "merchant"], "merchant", "m"),
             days(["_key", "posted_date"], None, "d"), days(["_key", "merchant", "posted_date"], "merchant", "md"),
             shaped(_middles(rows.withColumn("name", F.lit(None).cast("string"))), "av"),
             shaped(_middles(rows.withColumn("name", F.col("category"))), "cv")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _middles(rows: DataFrame) -> DataFrame:
    """_key, name, _pid, cents, n, below: the values around the median of the rows of (key, name) in earlier blocks."""
    key = ["_key", "_name"]  # _name: no nulls, so that it can be joined on
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), "name"), F.lit("")))
    held = cut_lineage(rows.groupBy(*key, "name", "_cents", "_pid").agg(F.count(F.lit(1)).alias("cnt")))
    size = held.groupBy(*key, "_pid").agg(F.sum("cnt").alias("m"))
    chunk_rows = F.lit(max(1, size.agg(F.max("m")).first()[0] or 1))
    ranked = keyed_running(held.groupBy(*key, "_cents").agg(F.sum("cnt").alias("all")), key, [F.asc("_cents")], {"upto": F.col("all")})
    chunk = F.floor((F.col("upto") - F.col("all")) / chunk_rows).alias("chunk")
    valued = cut_lineage(held.join(ranked.select(*key, "_cents", chunk), [*key, "_cents"]))
    cells = valued.groupBy(*key, "chunk", "_pid").agg(F.sum("cnt").alias("cnt"))
    # every chunk of a key against every block of it: counts only
    ends = size.groupBy(*key).agg(F.min("_pid").alias("p0"), F.max("_pid").alias("p1"))
    grid = (cells.select(*key, "chunk").distinct().join(ends, key)
            .select(*key, "chunk", F.explode(F.sequence("p0", "p1")).alias("_pid")).join(cells, [*key, "chunk", "_pid"], "left"))
    earlier = Window.partitionBy(*key, "chunk").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(*key, "_pid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = grid.withColumn("here", F.coalesce(F.sum("cnt").over(earlier), F.lit(0))).select(
        "*", F.coalesce(F.sum("here").over(smaller), F.lit(0)).alias("start"), F.sum("here").over(Window.partitionBy(*key, "_pid")).alias("total"))
    middle = (counted.join(size, [*key, "_pid"])
              .filter((F.col("here") > 0) & (2 * F.col("start") <= F.col("total") + F.col("m") + 4)
                      & (2 * (F.col("start") + F.col("here")) >= F.col("total") - F.col("m") - 4))
              .withColumn("below", F.min("start").over(Window.partitionBy(*key, "_pid")))
              .select(*key, "chunk", "_pid", "below", F.pmod("_pid", F.lit(SALTS)).cast("int").alias("salt")))
    # a chunk around the median is wanted by most blocks: its rows are dealt to SALTS tasks
    copies = valued.withColumnRenamed("_pid", "from").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (copies.join(middle, [*key, "chunk", "salt"]).filter(F.col("from") < F.col("_pid"))
            .groupBy(*key, "name", "_pid", F.col("_cents").alias("cents")).agg(F.sum("cnt").alias("n"), F.min("below").alias("below")))


def expanding(rows: DataFrame, block_rows: int = BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """`rows` with STATS of the strictly earlier rows of the account in the order (posted_date, transaction_id):
    mean, sample deviation, median and count by category (_c) and account (_a), count by merchant, the row before's date, and
    the counts of the row's whole day by merchant and account.

    `amount` is a decimal of scale 2; a null account, category, merchant or date is a value of its own (null dates first).
    `keep`: the columns of `rows` that come back (all): what neither these nor the statistics need is not moved.
    """
    keep = keep or rows.columns
    staged = rows.withColumn("_cents", (F.col("amount").cast("decimal(18,2)") * 100).cast("long"))
    staged = staged.select(*dict.fromkeys(["account_id", "transaction_id", "posted_date", "category", "merchant", *keep, "_cents"]))
    spark = rows.sparkSession
    counts = staged.groupBy("account_id").agg(F.count(F.lit(1)).alias("_rows"))
    largest, total = counts.agg(F.max("_rows"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    block_rows = max(block_rows, total // MOST_HOT)
    any_hot = (largest or 0) > block_rows
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_rows))
    plain = staged
    if any_hot:
        hot = cut_lineage(_keyed(counts).filter(F.col("_rows") > block_rows))  # at most MOST_HOT rows
        hot_rows = hot.agg(F.sum("_rows")).first()[0]
        plain = _keyed(staged).join(F.broadcast(hot.select("_key")), "_key", "left_anti").select(*staged.columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    back = [*keep, *[f.split()[0] for f in STATS.split(", ")]]

    def whole_accounts(rows: pa.Table) -> pa.Table:
        day = pc.fill_null(rows.column("posted_date").cast(pa.int32()), -2**31)
        return block_stats(rows.append_column("_key", rows.column("account_id")).append_column("_day", day)).select(back)

    out = (plain.withColumn("_pid", F.pmod(F.xxhash64("account_id"), F.lit(blocks)))
           .groupBy("_pid").applyInArrow(whole_accounts, f"{ddl}, {STATS}"))
    if any_hot:
        order = ["_key", "_day", "transaction_id"]
        mine = _keyed(staged).withColumn("_day", F.coalesce(F.datediff("posted_date", F.lit("1970-01-01").cast("date")), F.lit(-2**31).cast("int")))
        mine = mine.join(F.broadcast(hot.select("_key")), "_key", "left_semi").select(*mine.columns)
        ranged = cut_lineage(mine.repartitionByRange(max(1, -(-hot_rows // block_rows)), *order)
                             .withColumn("_pid", F.spark_partition_id().cast("long")))
        out = out.unionByName(ranged.groupBy("_pid").cogroup(_left_behind(ranged).groupBy("_pid"))
                              .applyInArrow(lambda rows, carry: block_stats(rows, carry).select(back), f"{ddl}, {STATS}"))
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """With `_key`: the account as text that is never null."""
    return rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("account_id").cast("string")), F.lit("")))
