import random

import pytest
from pyspark.sql import functions as F

CLASHING = ["key", "pos", "h", "score", "token", "start", "stop", "items", "digest", "page", "size", "rule", "copies", "spans", "target", "row", "hash", "text_hash", "th", "n", "node", "part", "_hash", "_null", "_source", "_copy", "_last", "_epochs", "_fp", "found", "place", "rank", "collapsed", "runs", "_h", "_words"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiklmnoprstuéß", k=rng.randint(2, 9))) for _ in range(words))


def awkward_rows():
    """Null and repeated ids and texts, empty and long texts, copies and near copies, null sources."""
    a, b, c = prose(1, 300), prose(2, 120), prose(3, 9000)
    rows = [
        (1, a, "s1"), (1, a, "s1"), (2, a, "s2"), (None, a, None), (None, None, "s1"), (3, None, "s2"), (4, "", None),
        (5, b, "s3"), (6, b.replace(" ", "\n", 7), "s3"), (7, c, "s1"), (8, c + " end", "s1"), (9, " \n\t ", "é"),
        (10, "x" * 5000, "s2"), (11, "ab " * 900, "s2"), (12, b[:60] + " changed " + b[60:], "s3"), (12, "other text", "s3"),
        (13, "A\u0301 ǅ \u2028 " + "𝔸" * 30, "s3"), (14, prose(4, 70) + " *** $$$ ### | | |" * 30, "s1"),
    ]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with more columns whose names an operator might use itself."""
    df = spark.createDataFrame(awkward_rows(), DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
