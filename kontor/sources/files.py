"""Ledger and feature files (CSV in, CSV/Parquet out).

Reads take their types from an explicit schema (no inference pass over the data); writes are
distributed (one file per task), never assembled on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.session import cut_lineage
from kontor.sources.tables import LEDGER_COLUMNS, LEDGER_SCHEMA

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_ledger_csv(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """A1: read 1..n ledger CSVs by header name; missing paths are skipped;
    error when none exists.

    The header of each path names its columns, so files may order them differently or hold more; a
    value that does not parse is null. With `multi_line`, values in quotes may hold line breaks; large files are read by
    many tasks all the same (see `quoted_records`), and such breaks stay as they are. Without it every line is a record.
    """
    frames = []
    for p in paths:
        try:
            text = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).csv(p)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        absent = [c for c in LEDGER_COLUMNS if c not in text.columns]
        if absent:
            raise ValueError(f"{p} has no column {', '.join(absent)}")
        if multi_line:
            text = _split_csv(spark, p, text)
        frames.append(text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]))
    if not frames:
        raise FileNotFoundError("no ledger CSV found in " + ", ".join(paths))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files at a path, with their file, byte range (`block`) and quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
                       (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """One row per byte range, written: its number, quotes, whether some line has an odd number of them (`odd`), whether it begins
    inside a record (`inside`), and the range where that record began (`owner`).

    A record is left open at a range's end if the quotes up to there are odd and the range changes their parity.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = (_lines(spark, path).groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("odd"))
               .withColumn("range", F.monotonically_increasing_id())
               .withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1))
    opens = (F.col("odd") == 1) & ((F.col("quotes") + F.col("inside").cast("long")) % 2 == 1)
    return cut_lineage(counted.withColumn("opens", opens)
                       .withColumn("owner", F.last(F.when(F.col("opens"), F.col("range")), ignorenulls=True).over(before)))


def _split_csv(spark: SparkSession, path: str, whole: DataFrame) -> DataFrame:
    """The rows of `whole` (a multi-line CSV frame over `path`), read by byte ranges. Only where some line has an odd number of
    quotes can a record span lines: else every line is a record, and nothing is shuffled. An odd number in a whole file is
    no RFC-4180 text; such a path is left to the multi-line reader."""
    ranges = _ranges(spark, path)
    files = (ranges.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.max("odd").alias("odd"), F.max("opens").alias("opens"))
             .agg(F.max("odd").alias("odd"), F.max(F.col("quotes") % 2).alias("broken"), F.max("opens").alias("opens")).first())
    if files.broken:
        return whole
    if not files.odd:
        return spark.read.options(**CSV_OPTIONS).schema(whole.schema).csv(path)
    parsed = F.from_csv("record", ", ".join(f"`{c.replace('`', '``')}` string" for c in whole.columns),
                        {**CSV_OPTIONS, "header": "false", "multiLine": "true"})
    return quoted_records(spark, path, ranges, files.opens).select(parsed.alias("row")).select("row.*")


def quoted_records(spark: SparkSession, path: str, ranges: DataFrame, opens: bool = True) -> DataFrame:
    """The records (without each file's header) of CSV files whose quoted values hold line breaks.

    A line begins a record if the quotes before it in its file are even in number. They are counted by byte range and added up
    over a file's ranges, so that a task joins the lines of its ranges by itself. Only the parts of records that
    go beyond a range (`opens`: there are some) meet, by the range where they began.
    """
    # one row per byte range
    lines = _lines(spark, path).join(F.broadcast(ranges.drop("quotes")), ["file", "block"]).select("range", "block", "inside", "owner", "value")
    schema = "owner long, block long, header boolean, record string"
    records = lines.mapInArrow(lambda batches: _joined_lines(batches, False), schema).filter("NOT header").select("record")
    if opens:
        parts = lines.mapInArrow(lambda batches: _joined_lines(batches, True), schema)
        records = records.unionByName(
            parts.groupBy("owner").agg(F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("_parts"))
            .filter("NOT header").select(F.array_join(F.col("_parts.record"), "\n").alias("record")))
    return records.select(F.regexp_replace("record", r"\r\z", "").alias("record")).filter(F.col("record") != "")


def _joined_lines(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """The records inside each byte range or, with `parts`, the pieces of those that go beyond it: what ends a record of an
    earlier range (or goes on with it), and what the last record has of its lines. A range's lines come together, in order."""
    now, block, owner, inside, ahead = None, 0, None, False, False
    held: list[pa.Array] = []  # lines of the record that is open
    first = False  # the next record is the file's header

    def row(of: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal first
        text = "\n".join(line for lines in held for line in lines.to_pylist())
        header, first = first and not ahead, first and ahead
        held.clear()
        if (of is not None) == parts:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([block], pa.int64()), pa.array([header]), pa.array([text])], names=names)

    names = ["owner", "block", "header", "record"]
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), numbers.size]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if numbers[a] != now:
                if held:
                    yield from row(owner if ahead else now)
                now, block, inside, owner = int(numbers[a]), batch.column(1)[a].as_py(), batch.column(2)[a].as_py(), batch.column(3)[a].as_py()
                ahead, first = inside, block == 0
            lines = batch.column(4).slice(a, b - a)
            after = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + inside) & 1
            starts = np.flatnonzero(np.concatenate([[int(inside)], after[:-1]]) == 0)
            inside = bool(after[-1])
            begin = int(starts[0]) if starts.size else b - a
            if begin:
                held.append(lines.slice(0, begin))
                if starts.size or not inside:
                    yield from row(owner if ahead else None)
                    ahead = False
            if not starts.size:
                continue
            ends = np.append(starts[1:], b - a)
            if inside:
                held.append(lines.slice(int(starts[-1])))
                starts, ends = starts[:-1], ends[:-1]
            if starts.size and not parts:
                offsets = pa.array(np.append(starts, ends[-1]).astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([lines])), "\n")
                header = np.zeros(starts.size, bool)
                header[0] = first
                yield pa.RecordBatch.from_arrays([pa.nulls(starts.size, pa.int64()), pa.array(np.full(starts.size, block)), pa.array(header), texts], names=names)
            first = first and not starts.size
    if held:
        yield from row(owner if ahead else now)


def write_ledger_csv(raw: DataFrame, path: str) -> None:
    """A5: RFC-4180 CSV with an explicit header: quotes only where needed,
    embedded quotes doubled, null as empty, exact decimal text."""
    (raw.select(*LEDGER_COLUMNS).write.mode("overwrite")
     .option("header", "true").option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").option("quoteAll", "false")
     # the writer trims values by default; a raw label like ' Coffee ' must survive
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("dateFormat", "yyyy-MM-dd").csv(path))


#: Sort order of the stored features: readers ask for months.
STORED_FEATURE_KEYS = ["month", "account_id"]


def write_monthly_features(features: DataFrame, path: str) -> int:
    """Feature rows sorted by month; a rerun replaces the account-months it contains and keeps the other accounts
    of those months, in one commit."""
    from kontor.operators.store import write_upsert
    return write_upsert(features, path, STORED_FEATURE_KEYS)


def read_monthly_features(spark: SparkSession, path: str) -> DataFrame:
    """The rows written last for each account-month."""
    from kontor.operators.store import read_upserted
    return read_upserted(spark, path, STORED_FEATURE_KEYS)


def write_labelled_months(assigned: DataFrame, names: DataFrame, path: str) -> None:
    """account_id, month, cluster, archetype."""
    labelled = assigned.select("account_id", "month", "cluster").join(
        names.select("cluster", F.col("name").alias("archetype")), "cluster")
    labelled.select("account_id", "month", "cluster", "archetype").write.mode("overwrite").parquet(path)
