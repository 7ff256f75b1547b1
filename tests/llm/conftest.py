from __future__ import annotations

import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers import the library by name
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "river", "stone", "Walks", "green", "über", "était", "niño", "light,", "house.", "cold"]
    return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "s", str(rnd.randint(0, 99)), str(rnd.randint(0, 9999))]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and repeated ids."""
    base, long = prose(1, 120), prose(2, 6000)
    lines = "\n".join(prose(k, 12) for k in range(8))
    texts = [
        None, "", " ", "\n\n\n", "a", "12345", "!!! ???", "日本語のテキスト", base, base, base.upper(), base + " end",
        long, "x" * 30_000, "ab " * 9000, lines, lines + "\nmore", prose(4, 90) + " " + base, "one two", "One  two",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, None, None, None), (None, None, None, None, None), (None, "null id", "en", "s", 7)]
    rows += [(11, "another text of a repeated id", "en", "s", 29)]
    rows += [(100 + k, prose(50 + k, 40 + 15 * k), ("en", "de")[k % 2], "s", 1) for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ["_id", "_text", "_vec", "_k0", "_lines", "_starts", "_node", "ids", "gram", "shard", "node", "label", "kept"]


@pytest.fixture(scope="session")
def clashing(hard_docs):
    """The same rows with columns named like the operators' working columns."""
    from pyspark.sql import functions as F

    return hard_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def rows_of(df):
    return sorted(map(repr, df.collect()))
