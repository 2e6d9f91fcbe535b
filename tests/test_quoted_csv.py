"""CSV whose quoted values hold line breaks, read by byte ranges: equal to the multi-line reader."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from kontor.sources import files
from kontor.sources.tables import LEDGER_COLUMNS

HEADER = "extra," + ",".join(LEDGER_COLUMNS)


def text_of(seed, n, end="\n", broken=True):
    rng, out = random.Random(seed), [HEADER]
    for i in range(n):
        shop = "".join(rng.choice(["a", " ", "\"\"", ",", "é", *([end, end + end, "\n"] if broken else [])]) for _ in range(rng.randrange(12)))
        out.append(f'"{shop}",t{seed}-{i},{rng.randrange(9)},2026-01-{rng.randrange(1, 29):02d},{rng.randrange(9999) / 100},"{shop}x","di,ning",false')
        if rng.random() < 0.05:
            out.append("")
    return end.join(out) + (end if seed % 2 else "")


def rows(df):
    return Counter(tuple(r) for r in df.select(*LEDGER_COLUMNS).collect())


@pytest.fixture
def ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_multi_line_reader(spark, tmp_path, ranges, end):
    folder = tmp_path / "ledger"
    folder.mkdir()
    for seed in (1, 2):
        (folder / f"{seed}.csv").write_bytes(text_of(seed, 700, end).encode())
    path = str(folder)
    assert files._lines(spark, path).select("file", "block").distinct().count() > 20  # byte ranges of both files
    whole = spark.read.options(**files.CSV_OPTIONS).option("multiLine", "true").csv(path)
    raw = Counter(tuple(r) for r in whole.collect())
    found = [tuple(r) for r in files._split_csv(spark, path, whole).collect()]
    # the multi-line reader gives \n for a line break of the file's kind; here values stay as they are
    split = Counter(tuple(v and v.replace(end, "\n") for v in r) for r in found)
    assert sum(raw.values()) == 1400 and split == raw
    assert any(end in (r[0] or "") for r in found)
    got = files.read_ledger_csv(spark, [path, str(tmp_path / "none")])
    assert got.count() == 1400 and any("\n" in (r.merchant or "") for r in got.collect())


def test_one_value_over_many_ranges(spark, tmp_path, ranges):
    long = "x\n" * 20_000
    path = tmp_path / "one.csv"
    path.write_text(f'{HEADER}\n"{long}",t1,1,2026-01-01,1.00,a,dining,false\ne,t2,1,2026-01-02,2.00,"b\nb",dining,true\n')
    whole = spark.read.options(**files.CSV_OPTIONS).option("multiLine", "true").option("maxCharsPerColumn", "-1").csv(str(path))
    got = files._split_csv(spark, str(path), whole)
    assert {(r.extra, r.transaction_id, r.merchant) for r in got.collect()} == {(long, "t1", "a"), ("e", "t2", "b\nb")}


def test_files_without_breaks_and_broken_files(spark, tmp_path, ranges):
    plain, broken, empty = (tmp_path / f"{n}.csv" for n in ("plain", "broken", "empty"))
    plain.write_text(text_of(3, 400, broken=False))
    broken.write_text(f'{HEADER}\ne,t1,1,2026-01-01,1.00,5" nail,dining,false\n')
    empty.write_text(HEADER + "\n")
    frame = files.read_ledger_csv(spark, [str(plain)])
    assert frame.rdd.getNumPartitions() > 1 and "Exchange" not in frame._jdf.queryExecution().toString()
    assert frame.count() == 400
    assert [r.merchant for r in files.read_ledger_csv(spark, [str(broken)]).collect()] == ['5" nail']
    assert files.read_ledger_csv(spark, [str(empty)]).count() == 0


def test_lines_are_joined_inside_their_range(spark, tmp_path, ranges, monkeypatch):
    """What is written on the way has a row per byte range, not per line; a header may hold line breaks too."""
    path = tmp_path / "ledger.csv"
    path.write_bytes(text_of(5, 900).replace("extra,", '"ex\ntra",', 1).encode())
    written = []
    monkeypatch.setattr(files, "cut_lineage", lambda df, cut=files.cut_lineage: (written.append(cut(df)), written[-1])[1])
    whole = spark.read.options(**files.CSV_OPTIONS).option("multiLine", "true").csv(str(path))
    got = files._split_csv(spark, str(path), whole)
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in whole.collect())
    n = files._lines(spark, str(path)).select("file", "block").distinct().count()
    assert n > 10 and [w.count() for w in written] == [n]


def test_a_long_header_over_many_ranges(spark, tmp_path, ranges):
    path = tmp_path / "long.csv"
    name = "x\n" * 6000
    path.write_text(f'"{name}",' + ",".join(LEDGER_COLUMNS) + '\ne,t1,1,2026-01-01,1.00,"a\nb",dining,false\n')
    ranges_of = files._ranges(spark, str(path))
    assert ranges_of.count() > 2
    assert [r.record for r in files.quoted_records(spark, str(path), ranges_of).collect()] == ['e,t1,1,2026-01-01,1.00,"a\nb",dining,false']
