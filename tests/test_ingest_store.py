"""Change feed (M) and score store (K) semantics on tiny frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kontor.operators import ingest as M
from kontor.operators import store as K
from kontor.sources.files import read_monthly_features, write_monthly_features
from kontor.sources.runs import Conflict, RunTable, latest
from kontor.streaming import sync as S
from kontor.streaming.burst import run_burst_counts
from kontor.streaming.sync import FEED_SCHEMA, incremental_sync, write_feed

D = dt.date(2026, 5, 1)
LEDGER = "transaction_id string, account_id long, posted_date date, amount decimal(12,2), " \
         "merchant string, category string, pending boolean"


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([(1, "a", "ext-1", "tok", None, "IDLE"), (2, "b", "ext-2", None, None, "IDLE")],
                                 "account_id long, name string, external_account_id string, "
                                 "access_token string, sync_cursor string, sync_status string")


def feed(spark, rows):
    full = []
    for r in rows:
        tid, ext, amount, kind, page, seq, *rest = r
        merchant = rest[0] if rest else "Shop"
        full.append((tid, ext, D, float(amount), merchant, None, None, "FOOD_AND_DRINK", kind, page, seq))
    return spark.createDataFrame(full, FEED_SCHEMA)


def base(spark, rows=()):
    from decimal import Decimal
    return spark.createDataFrame([(t, a, D, Decimal(str(x)), "Shop", "dining", False) for t, a, x in rows], LEDGER)


def result(df):
    return {r.transaction_id: r for r in df.collect()}


def test_insert_modify_remove(spark, accounts):
    ch = feed(spark, [("n1", "ext-1", 10, "added", 0, 1), ("x1", "ext-1", 99, "modified", 0, 2),
                      ("x2", "ext-2", 5, "removed", 0, 3)])
    out = result(M.sync(base(spark, [("x1", 2, 1), ("x2", 2, 2)]), ch, accounts))
    assert set(out) == {"n1", "x1"}
    assert float(out["x1"].amount) == 99.0
    assert out["x1"].account_id == 2  # an update keeps the stored account


def test_idempotent(spark, accounts):
    ch = feed(spark, [("n1", "ext-1", 10, "added", 0, 1), ("n1", "ext-1", 11, "modified", 1, 2)])
    once = M.sync(base(spark), ch, accounts)
    twice = M.sync(once, ch, accounts)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert float(result(once)["n1"].amount) == 11.0


def test_remove_then_readd_in_one_sync_stays_removed(spark, accounts):
    ch = feed(spark, [("n1", "ext-1", 10, "removed", 0, 1), ("n1", "ext-1", 10, "added", 1, 2)])
    assert "n1" not in result(M.sync(base(spark), ch, accounts))


def test_orphans_skipped_and_counted(spark, accounts):
    ch = feed(spark, [("o1", "ext-9", 10, "added", 0, 1), ("o2", "ext-9", 10, "modified", 0, 2),
                      ("n1", "ext-1", 10, "added", 0, 3), ("n1", "ext-1", 12, "added", 1, 4)])
    out = M.sync(base(spark), ch, accounts)
    assert set(result(out)) == {"n1"}
    _, orphans = M.quarantine_orphans(ch, accounts)
    assert orphans.count() == 2
    c = M.sync_counts(base(spark), ch, accounts).first()
    assert (c.added, c.modified, c.removed, c.pages) == (1, 1, 0, 3)  # page 0 of ext-9, pages 0 and 1 of ext-1


def test_feed_fallbacks(spark):
    from kontor.operators.ledger import map_feed_record
    rows = [("a", "ext-1", D, 1.005, "  ", "Name", None, None, "added", 0, 1),
            ("b", "ext-1", D, 2.0, None, None, True, "TRAVEL", "added", 0, 2),
            ("c", "ext-1", D, 99999999999.99, "\t", "\u2003\n", None, None, "added", 0, 3),
            ("d", "ext-1", D, 1.0, "\u00a0", "Name", None, None, "added", 0, 4)]
    m = result(map_feed_record(spark.createDataFrame(rows, FEED_SCHEMA)))
    assert m["a"].merchant == "Name" and m["a"].category == "OTHER" and m["a"].pending is False
    assert m["b"].merchant == "Unknown"
    assert str(m["a"].amount) == "1.01"  # decimal text 1.005, scale 2 half up
    assert m["c"].merchant == "Unknown" and m["c"].amount is None  # a tab is blank; too large an amount does not abort the job
    assert m["d"].merchant == "\u00a0"  # a no-break space is not blank


def test_streaming_sync_equals_batch_and_replays_noop(spark, accounts, tmp_path):
    ch = feed(spark, [("n1", "ext-1", 10, "added", 0, 1), ("x1", "ext-1", 99, "modified", 0, 2),
                      ("x2", "ext-2", 5, "removed", 0, 3)])
    b = base(spark, [("x1", 2, 1), ("x2", 2, 2)])
    write_feed(ch, str(tmp_path / "feed"))
    args = (str(tmp_path / "feed"), str(tmp_path / "ledger"), str(tmp_path / "ckpt"), accounts, b)
    first = incremental_sync(spark, *args)
    again = incremental_sync(spark, *args)  # nothing new: no-op
    batch = M.sync(b, ch, accounts)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def state(df):
    return sorted((r.transaction_id, r.account_id, float(r.amount)) for r in df.collect())


def test_sync_in_two_batches_writes_only_its_ids(spark, accounts, tmp_path):
    dirs = [str(tmp_path / x) for x in ("feed", "ledger", "ckpt")]
    b = base(spark, [(f"x{i}", 2, i) for i in range(40)])
    write_feed(feed(spark, [("n1", "ext-1", 10, "added", 0, 7), ("o1", "ext-9", 3, "added", 0, 8)]), dirs[0])
    incremental_sync(spark, *dirs, accounts, b)
    second = feed(spark, [("n1", "ext-1", 11, "modified", 0, 9), ("x3", "ext-2", 0, "removed", 0, 10)])
    write_feed(second, dirs[0])
    got = incremental_sync(spark, *dirs, accounts, b)
    assert state(got) == sorted([(f"x{i}", 2, float(i)) for i in range(40) if i != 3] + [("n1", 1, 11.0)])
    number, runs = S.ledger_table(spark, dirs[1]).state()
    assert number == 3 and [r["rows"] for r in runs] == [40, 2]  # the first sync's run is merged into the second's
    assert [(r.transaction_id, len(r.sync)) for r in S.quarantined(spark, dirs[1]).collect()] == [("o1", 32)]
    done = {r.external_account_id: (r.sync_cursor, r.sync_status) for r in S.synced_accounts(spark, dirs[1], accounts).collect()}
    assert done["ext-1"] == ("9", "IDLE") and done["ext-2"][0] == "10"
    assert S.vacuum(spark, dirs[1]) > 0
    assert state(S.current_ledger(spark, dirs[1])) == state(got)


def test_failed_and_replayed_sync(spark, accounts, tmp_path, monkeypatch):
    dirs = [str(tmp_path / x) for x in ("feed", "ledger", "ckpt")]
    b = base(spark, [("x1", 2, 1), ("x2", 2, 2)])
    write_feed(feed(spark, [("n1", "ext-1", 10, "added", 0, 1)]), dirs[0])
    first = state(incremental_sync(spark, *dirs, accounts, b))
    write_feed(feed(spark, [("x1", "ext-2", 5, "modified", 0, 2), ("x2", "ext-2", 0, "removed", 0, 3)]), dirs[0])
    real = RunTable._swap

    def broken(self, number, runs, sync):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(RunTable, "_swap", broken)
    with pytest.raises(Exception):
        incremental_sync(spark, *dirs, accounts, b)
    assert state(S.current_ledger(spark, dirs[1])) == first  # nothing of the failed sync shows
    monkeypatch.setattr(RunTable, "_swap", real)
    after = state(incremental_sync(spark, *dirs, accounts, b))
    assert after == [("n1", 1, 10.0), ("x1", 2, 5.0)]
    again = state(incremental_sync(spark, dirs[0], dirs[1], str(tmp_path / "lost-checkpoint"), accounts, b))
    assert again == after  # applied files are skipped


def test_new_files_after_a_lost_checkpoint(spark, accounts, tmp_path):
    """A fresh checkpoint counts batches from 0 again and meets old and new files in one batch."""
    dirs = [str(tmp_path / x) for x in ("feed", "ledger", "ckpt")]
    b = base(spark, [("x1", 2, 1)])
    write_feed(feed(spark, [("n1", "ext-1", 10, "added", 0, 1)]), dirs[0])
    incremental_sync(spark, *dirs, accounts, b)
    write_feed(feed(spark, [("n1", "ext-1", 0, "removed", 0, 2), ("n2", "ext-1", 4, "added", 0, 3)]), dirs[0])
    for name in ("second", "third"):
        got = incremental_sync(spark, dirs[0], dirs[1], str(tmp_path / name), accounts, b)
        assert state(got) == [("n2", 1, 4.0), ("x1", 2, 1.0)]
    assert S.applied_files(spark, dirs[1]).count() >= 2


def test_syncs_one_by_one_equal_the_batch_form(spark, accounts, tmp_path):
    """Ids that come, go and come back under another account, in many syncs and merges."""
    rng = random.Random(4)
    ids, where, seq = [f"t{i}" for i in range(12)], str(tmp_path / "ledger"), 0
    want = base(spark, [(t, 2, 1) for t in ids[:6]])
    first = want
    for k in range(9):
        rows = []
        for t in rng.sample(ids, 4):
            for kind in rng.choice([["added"], ["modified"], ["removed"], ["added", "removed"], ["modified", "added"]]):
                seq += 1
                rows.append((t, rng.choice(["ext-1", "ext-2", "ext-9"]), seq, kind, 0, seq))
        changes = feed(spark, rows)
        S.apply_files(spark, where, changes.withColumn("file", F.lit(f"f{k}")), accounts, first)
        want = spark.createDataFrame(M.sync(want, changes, accounts).collect(), S.LEDGER_SCHEMA)
        assert state(S.current_ledger(spark, where)) == state(want)


def test_a_sync_writes_in_proportion_to_its_rows(spark, accounts, tmp_path):
    where = str(tmp_path / "ledger")
    big = spark.range(200_000).select(F.concat(F.lit("b"), "id").alias("transaction_id"), F.lit(2).cast("long").alias("account_id"), F.lit(D).alias("posted_date"),
                                      F.lit(1).cast("decimal(12,2)").alias("amount"), F.lit("Shop").alias("merchant"), F.lit("dining").alias("category"), F.lit(False).alias("pending"))
    written = []
    for k in range(6):
        rows = spark.range(1000).select(F.concat(F.lit("b"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(200_000))).alias("transaction_id")).distinct()
        changes = rows.select("transaction_id", F.lit("ext-2").alias("external_account_id"), F.lit(D).alias("date"), F.lit(7.0 + k).alias("amount"),
                              F.lit("M").alias("merchant_name"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("pending"),
                              F.lit("TRAVEL").alias("primary_category"), F.lit("modified").alias("kind"), F.lit(0).alias("page"), F.lit(1).cast("long").alias("seq"))
        written.append(S.apply_files(spark, where, changes.withColumn("file", F.lit(f"f{k}")), accounts, big))
    assert written[0] < 202_000 and max(written[1:]) < 6_000 and sum(written[1:]) < 20_000
    ledger = S.current_ledger(spark, where)
    assert ledger.count() == 200_000 and ledger.filter("amount = 12").count() > 900


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """A writer that is overtaken between reading and committing folds its rows onto the other's."""
    keys, path = ["k"], str(tmp_path / "t")
    make = lambda: RunTable(spark, path, "k long, v long", keys, latest(keys))
    rows = lambda *kv: spark.createDataFrame(list(kv), "k long, v long")
    make().commit(rows((1, 1), (2, 1)))
    real, once = RunTable._swap, []

    def overtaken(self, number, runs, sync):
        if not once:
            once.append(1)
            make().commit(rows((2, 20), (3, 20)))
        real(self, number, runs, sync)

    monkeypatch.setattr(RunTable, "_swap", overtaken)
    make().commit(rows((1, 30), (None, 30)))
    monkeypatch.setattr(RunTable, "_swap", real)
    assert {r.k: r.v for r in make().read().collect()} == {1: 30, 2: 20, 3: 20, None: 30}
    assert make().state()[0] == 3 and make().committed().count() == 3
    with pytest.raises(Conflict):
        real(make(), 3, [], "late")
    assert make().vacuum() > 0 and make().read().count() == 4


def test_late_rows_count(spark, tmp_path):
    """Rows that arrive days after later ones are counted, and a repeated run adds nothing."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    where = tmp_path / "data"
    where.mkdir()

    def land(name, days):
        pq.write_table(pa.table({
            "event_id": pa.array(range(len(days)), pa.int64()), "ts": pa.array([dt.datetime(2026, 5, d, 12) for d in days], pa.timestamp("us")),
            "user_id": pa.array([1] * len(days), pa.int64()), "event_type": ["purchase"] * len(days),
            "value": [5.0] * len(days), "props": ['{"k": 1}'] * len(days)}), where / name)

    land("events.parquet", [20, 20])
    args = (spark, str(where), str(tmp_path / "out"), str(tmp_path / "ckpt"), 1)
    run_burst_counts(*args)
    land("events-2.parquet", [1, 20])
    for ckpt in ("ckpt", "ckpt", "lost"):
        args = (*args[:3], str(tmp_path / ckpt), 1)
        got = sorted((str(r.day), r.merchant_txns_same_day) for r in run_burst_counts(*args).collect())
        assert got == [("2026-05-01", 1), ("2026-05-20", 3)]


# --- K -------------------------------------------------------------------------

SCORES = "subject_type string, subject_id string, model_name string, score double, label string, scored_at timestamp"


def test_upsert_and_latest(spark):
    t0, t1 = dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 2)
    old = spark.createDataFrame([("TRANSACTION", "a", "v1", 0.1, "NORMAL", t0),
                                 ("TRANSACTION", "a", "v2", 0.2, "NORMAL", t0)], SCORES)
    new = spark.createDataFrame([("TRANSACTION", "a", "v1", 0.9, "ANOMALY", t1)], SCORES)
    ups = K.upsert_scores(old, new)
    assert ups.count() == 2  # other versions stay side by side
    latest = K.latest_score(ups).first()
    assert latest.model_name == "v1" and latest.score == 0.9


def test_fallback_cases(spark):
    """Every answer of the month half: live, thin, stored, nothing stored, no transactions."""
    keys = "account_id long, month date"
    m1, m2, m3, m4, m5 = (dt.date(2026, i, 1) for i in (1, 2, 3, 4, 5))
    late = dt.date(2028, 1, 1)
    ledger = base(spark, [("a", 1, 5)]).withColumn("posted_date", F.lit("2026-01-15").cast("date"))
    requested = spark.createDataFrame([(1, m1, True), (1, m2, False), (1, m3, False), (1, m4, True), (1, m5, False), (1, late, False),
                                       (2, m1, True)], keys + ", service_up boolean")
    requested = K.with_history(requested, ledger)
    assert {(r.account_id, r.month): r.rows_in_window for r in requested.collect()} == {
        (1, m1): 1, (1, m2): 1, (1, m3): 1, (1, m4): 1, (1, m5): 1, (1, late): 0, (2, m1): 0}
    features = spark.createDataFrame([(1, m1), (1, m2), (1, m3)], keys)
    live = spark.createDataFrame([(1, m1, "Dining Led", 1.5, "v")], keys + ", label string, score double, model_name string")
    stored = spark.createDataFrame([(1, m2, "Commuter", 2.5, "v0", dt.datetime(2026, 3, 1)), (1, m5, "Commuter", 1.0, "v0", dt.datetime(2026, 6, 1))],
                                   keys + ", label string, score double, model_name string, scored_at timestamp")
    got = {(r.account_id, r.month): r for r in K.scores_with_fallback(requested, features, live, stored).collect()}
    answer = lambda *k: (got[k].archetype, got[k].stale, got[k].note)
    assert answer(1, m1) == ("Dining Led", False, None)
    assert answer(1, m2) == ("Commuter", True, "Last scored 2026-03-01T00:00:00") and got[1, m2].description == K.NOTE_STALE
    assert answer(1, m3) == (None, True, K.NOTE_NONE)
    assert answer(1, m4) == (None, False, K.NOTE_THIN)
    assert answer(1, m5) == (None, True, K.NOTE_NONE)  # service down and no feature row: no earlier result
    assert answer(1, late) == answer(2, m1) == (None, False, K.NOTE_NO_TRANSACTIONS)


def test_scan_fallback_cases(spark):
    ledger = base(spark, [("a", 1, 5), ("b", 2, 5), ("c", 3, 5), ("old", 4, 5)]).withColumn(
        "posted_date", F.when(F.col("account_id") == 4, F.lit("2020-01-01")).otherwise(F.lit("2026-05-01")).cast("date"))
    requested = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, False)], "account_id long, service_up boolean")
    live = spark.createDataFrame([(1, "a", True, "v"), (1, "a2", False, "v"), (4, "old", True, "v")],
                                 "account_id long, transaction_id string, is_anomaly boolean, model_version string")
    flags = spark.createDataFrame([(1,), (3,), (3,)], "account_id long")
    got = {r.account_id: tuple(r)[1:] for r in K.scan_with_fallback(requested, ledger, live, flags, "2026-06-01").collect()}
    assert got == {1: (2, 1, "v", False, None), 2: (0, 0, None, False, K.NOTE_NOTHING_SCORABLE),
                   3: (0, 2, None, True, K.NOTE_STALE_FLAGS), 4: (0, 0, None, False, K.NOTE_NO_TRANSACTIONS),
                   5: (0, 0, None, False, K.NOTE_NO_TRANSACTIONS)}


def test_written_upsert_keeps_other_accounts(spark, tmp_path, monkeypatch):
    """A8 and K1 on disk: a batch of some accounts leaves the others of the month as they were; a job that is lost before its
    commit leaves all of it, and a writer that is overtaken keeps the other's rows."""
    path = str(tmp_path / "features")
    rows = "account_id long, month date, txn_count double"
    may, june = dt.date(2026, 5, 1), dt.date(2026, 6, 1)
    held = lambda: {(r.account_id, r.month): r.txn_count for r in read_monthly_features(spark, path).collect()}
    write = lambda *r: write_monthly_features(spark.createDataFrame(list(r), rows), path)
    write((1, may, 1.0), (2, may, 2.0), (1, june, 3.0))
    write((2, may, 9.0), (3, may, 4.0))
    want = {(1, may): 1.0, (2, may): 9.0, (3, may): 4.0, (1, june): 3.0}
    assert held() == want
    real, other = RunTable._swap, []

    def lost(self, number, runs, sync):
        raise RuntimeError("lost between files")

    def overtaken(self, number, runs, sync):
        if not other:
            other.append(1)
            write((4, may, 5.0), (1, may, 6.0))
        real(self, number, runs, sync)

    monkeypatch.setattr(RunTable, "_swap", lost)
    with pytest.raises(RuntimeError):
        write((1, may, 100.0), (9, june, 100.0))
    assert held() == want
    monkeypatch.setattr(RunTable, "_swap", overtaken)
    write((1, may, 7.0), (5, june, 8.0))
    assert held() == want | {(1, may): 7.0, (4, may): 5.0, (5, june): 8.0}


def test_match_scores_by_id_not_position(spark):
    scored = spark.createDataFrame([("b", 0.7, True), ("a", 0.1, False), ("zz", 0.5, False)],
                                   "transaction_id string, anomaly_score double, is_anomaly boolean")
    raw = base(spark, [("a", 1, 1), ("b", 1, 2)])
    matched, unknown = K.match_scores_by_id(scored, raw)
    assert {r.transaction_id: r.label for r in matched.collect()} == {"a": "NORMAL", "b": "ANOMALY"}
    assert [r.transaction_id for r in unknown.collect()] == ["zz"]
    assert F is not None


def test_files_are_compared_by_name_without_moving_rows(spark):
    """One file's rows stay in the tasks that read them, whatever the planner knows about the applied files."""
    from kontor.streaming.sync import unapplied
    batch = spark.range(0, 1000, 1, 4).selectExpr("id", "concat('f', id % 3) AS file")
    applied = spark.createDataFrame([("f1", "s"), ("f1", "t"), ("elsewhere", "s")], "file string, sync string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = unapplied(batch, applied)
        assert "hashpartitioning" not in new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 667 and {r.file for r in new.select("file").distinct().collect()} == {"f0", "f2"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """Sorting, folding and counting take as many tasks as there are rows for, not the session's number of partitions."""
    import os
    from kontor.sources import runs
    monkeypatch.setattr(runs, "TASK_ROWS", 10)
    table = runs.RunTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], runs.summed(["k"], "n"))
    table.commit(spark.range(200).selectExpr("id AS k", "1L AS n"))
    table.commit(spark.range(190, 205).selectExpr("id AS k", "2L AS n"))
    folder = f"{tmp_path}/t/{table.state()[1][0]['path']}"
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runs.by_rows(spark.range(25), 25, ["id"]).rdd.getNumPartitions() == 3
    assert {r.k: r.n for r in table.read().collect()} == {k: (k < 200) + 2 * (k >= 190) for k in range(205)}
