from __future__ import annotations

import re
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: One row a corner: null and empty texts, repeats, ties, other scripts, rows twice, a null id, a text without a line break.
CORNERS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (4, "One two three four five six seven", "en", "a"), (5, "one TWO three four five six seven", "en", "b"),
    (5, "one TWO three four five six seven", "en", "b"), (6, "Élan ÉLAN élan", "fr", "b"), (7, "a b c", "en", "a"), (8, "A b c", "en", "a"), (9, "x\ny\nx\ny\nx", "en", "c"),
    (None, "no id here at all", "en", "a"), (10, "word " * 60_000, "en", "a"), (11, "z" * 300_000, "en", "a"), (12, "mail: jo.do@mail.example.org, +1 (415) 555-0100.", "en", "a"),
]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def corners(spark):
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in CORNERS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(corners):
    """Further columns named like what operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "row", "digest", "sid", "key", "gone", "left_out", "score", "kept", "tokens", "part", "a.b"]
    return corners.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()
