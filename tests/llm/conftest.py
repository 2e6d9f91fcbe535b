from __future__ import annotations

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside; they must neither disturb nor be disturbed.
CLASHING = ["size", "rank", "start", "block", "shard", "slot", "granule", "place", "bucket", "cls", "root", "n",
            "a", "b", "h", "_at", "_part", "_r", "_rows", "part", "rows", "lang_pred", "score", "words", "target", "tokens"]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORDS.findall(fold(text))


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(1, 30000)
    base = prose(2, 60)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, "one", "en", "b", 3),
        (5, long, "en", "b", len(long)), (6, base, None, None, 1), (6, base, None, None, 1), (7, base, "fr", "c", 1),
        (8, base.upper(), "fr", "c", 1), (None, base, "de", "c", 1), (None, None, None, None, None),
        (9, base + " extra", "en", "c", 1), (10, "12 34 --", "en", "a", 8), (11, "é ñ", "es", "é", 3), (12, "A b\x0bC d\x0ce f g", "en", "a", 9),
        (13, "x y z", "en", "\U0001f600", 5),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DDL)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    from pyspark.sql import functions as F
    return edges.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def listed(df, *order) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
