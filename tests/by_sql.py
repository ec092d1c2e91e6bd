"""Random texts, and what the independent SQL makes of them."""

import random

import duckdb
import pyarrow as pa

from checks import oracle


def random_texts(n, seed, pieces, length=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(length))) for _ in range(n)]


def by_sql(texts, columns, define):
    """Rows of ``columns`` in the order of the texts; ``define`` names expressions over sample(k, raw)."""
    oracle.CTES.pop("sample", None)
    oracle.cte("sample", "select k, raw from sample_table")
    last = define()
    oracle.ask("_sample", f"select {columns} from {last} order by k", last)
    connection = duckdb.connect()
    connection.register("sample_table", pa.table({"k": list(range(len(texts))), "raw": texts}))
    return connection.sql(oracle.ORACLE.pop("_sample")).fetchall()


def cleaned_by_sql(texts):
    def define():
        oracle.clean_ctes("sample_clean", "sample")
        return "sample_clean"

    return [r[0] for r in by_sql(texts, "out", define)]


def sections_by_sql(texts):
    def define():
        oracle.cte("sample_plain", "select k, raw as out from sample", "sample")
        oracle.section_ctes("sample_s", "sample_plain")
        return "sample_s_sections"

    return by_sql(texts, "summary, skills, experience", define)
