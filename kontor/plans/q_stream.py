"""Registered queries for the streaming operators (M6, O1).

Both run the stream to completion (`availableNow`) over data derived from the
driver tables, then return the sink table; their SQL twins are the batch
forms they must equal.
"""

from __future__ import annotations

import uuid

from kontor.plans.common import EV_SQL, with_ledgers
from kontor.plans.q_ingest import APPLY, HEAD, LEDGER_OUT
from kontor.plans.registry import flat, query
from kontor.plans.sql_blocks import LED
from kontor.session import ensure_checkpoint_dir
from kontor.sources import feed as FD
from kontor.streaming import burst, sync


def _scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-stream/{what}-{uuid.uuid4().hex}"


@query("incremental_sync", HEAD + "," + APPLY + "\n" + LEDGER_OUT + " FROM synced")
def q_incremental_sync(spark, sf):
    root = _scratch(spark, "sync")
    sync.write_feed(FD.change_feed(spark, sf), f"{root}/feed")
    out = sync.incremental_sync(spark, f"{root}/feed", f"{root}/ledger", f"{root}/_checkpoint",
                                FD.feed_accounts(spark, sf), FD.base_ledger(spark, sf))
    return flat(out)


@query("streaming_burst_counts", with_ledgers(("raw", EV_SQL)) + ",\n" + LED + """
SELECT account_id, merchant, strftime(posted_date, '%Y-%m-%d') AS day, count(*) AS merchant_txns_same_day
FROM led WHERE NOT is_inflow AND amount > 0 GROUP BY account_id, merchant, posted_date""")
def q_streaming_burst_counts(spark, sf):
    root = _scratch(spark, "burst")
    out = burst.run_burst_counts(spark, sf, f"{root}/counts", f"{root}/_checkpoint")
    return flat(out.select("account_id", "merchant", "day", "merchant_txns_same_day"))
