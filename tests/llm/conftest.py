import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; an input may have them too.
CLASHING = ["size", "score", "fp", "component", "_id", "_th", "_h", "_row", "_hash", "hash", "n_deleted", "n_lines", "label", "key", "copies", "window"]


def words(n, seed, alphabet="abcdefgh"):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long text, repeated rows, ties, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(["word", "other", "thing"] * 60_000) + "\n" + words(500, 1)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, long, "en", "b", len(long)), (5, words(80, 2), "de", "b", 1), (5, words(80, 2), "de", "b", 1), (6, words(80, 2), "de", None, 1),
        (None, words(90, 3), "en", "c", 1), (None, None, None, None, None), (7, "x", "fr", "c", 1), (8, "Ünïcödé ß 漢字 \U0001f600 don't", "fr", "c", 1), (9, words(60, 4) + "\n\n" + words(70, 5), "en", "a", 1), (10, words(70, 5) + "\n" + words(5, 6), "en", "a", 1), (11, "\x01\x02 a<|endoftext|>b", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
