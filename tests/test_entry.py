"""Driver contract: entry() runs, every oracle belongs to a registered query."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "recurring_share" in df.columns


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_small_queries_match_oracle(spark):
    """A few cheap queries against DuckDB at the smallest scale factor."""
    import duckdb

    sf = entry.SMOKE_DIR
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("category_summary", "monthly_features_events", "transaction_features", "apply_removals"):
        s = entry.queries()[name](spark, sf)
        cols = sorted(s.columns)
        srows = sorted(tuple(r[c] for c in cols) for r in s.collect())
        res = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in res.description]
        drows = sorted(tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall())
        assert len(srows) == len(drows), name
        for a, b in zip(srows, drows):
            for x, y in zip(a, b):
                if isinstance(x, float) and isinstance(y, float):
                    assert abs(x - y) < 1e-6, name
                else:
                    assert x == y, name
