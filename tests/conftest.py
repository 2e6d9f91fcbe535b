from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kontor.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", shuffle_partitions=8, app_name="kontor-tests")
    yield s
    s.stop()


LEDGER_DDL = ("transaction_id string, account_id long, posted_date date, amount decimal(12,2), "
              "merchant string, category string, pending boolean")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


@pytest.fixture
def ledger(spark):
    """Build a raw ledger from (date, amount, merchant?, category?, account?) rows;
    ids are generated in row order so they also order ties."""
    def make(rows):
        out = []
        for i, r in enumerate(rows):
            date, amount, *rest = r
            merchant = rest[0] if len(rest) > 0 else "Shop"
            category = rest[1] if len(rest) > 1 else "dining"
            account = rest[2] if len(rest) > 2 else 1
            out.append((f"t{i:05d}", account, d(date), Decimal(str(amount)), merchant, category, False))
        return spark.createDataFrame(out, LEDGER_DDL)
    return make
