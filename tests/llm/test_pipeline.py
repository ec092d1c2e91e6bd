"""The pipeline against plain versions of its stages, and its stages on awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from sieveline.llm import bytecnn
from sieveline.llm.queries import QUERIES, table
from tests.llm.test_operators import WORD_BPE, components_of, contamination_of, fingerprint_of, targets_of, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_pipeline(spark, data):
    rows = [tuple(r) for r in table(spark, data, "documents").select(*COLUMNS).collect()]
    net = bytecnn.train(table(spark, data, "documents"), table(spark, data, "labels"))
    rows = [r for r in rows if net.score([(r[1] or "").encode()])[0] >= 0.3]
    components = components_of([r[0] for r in rows], [fingerprint_of(r[1], 4) for r in rows])
    rows = [r for r, c in zip(rows, components) if r[0] == c]
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, data, "benchmark").collect()]
    rows = [r for r in rows if not contamination_of(r[1], items)[4]]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    mixed = []
    for source, target in targets_of(sizes).items():
        epochs, rest = divmod(round(target), sizes[source])
        before = 0
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            size = len(words(r[1]))
            mixed += [r] * (epochs + (rest > 0 and 2 * (rest - before) >= size))
            before += size
    tokenizer, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for r in sorted(mixed):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_run_equals_the_plain_version(spark, data):
    found = corpus_pipeline.run(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    expected = plain_pipeline(spark, data)
    assert len(expected) > 50
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_rows_and_none(spark, awkward, empty_docs, data, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, awkward, data)
    last = stage == len(corpus_pipeline.STAGES) - 1
    assert last or out.columns == awkward.columns
    assert out.count() > 0
    if not last:
        texts = {r["text"] for r in awkward.select("text").collect()}
        assert {r["text"] for r in out.select("text").collect()} <= texts
        assert out.where(" or ".join(f"{c} <> 'clash'" for c in awkward.columns[5:])).count() == 0
    assert run(spark, empty_docs, data).count() == 0


def test_clean_documents_stay(spark, data):
    """Each filtering stage keeps clean, unique documents of good quality."""
    labels = table(spark, data, "labels").where("quality = 1 and toxic = 0")
    docs = table(spark, data, "documents").join(labels.select("doc_id"), "doc_id").where("length(text) > 300")
    kept = corpus_pipeline.quality(spark, docs, data).count()
    assert kept >= 0.97 * docs.count()


def test_queries_are_registered():
    names = set(entry_points.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, data, name):
    import duckdb

    found = QUERIES[name](spark, data)
    rows = found.toArrow()
    assert rows.num_rows > 0
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        connection.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    expected = connection.sql(sql).to_arrow_table()
    columns = sorted(rows.column_names)
    assert columns == sorted(expected.column_names)
    as_rows = lambda x: sorted(zip(*[map(repr, x[c].to_pylist()) for c in columns]))
    assert as_rows(rows) == as_rows(expected)


def test_lists_of_ids_do_not_depend_on_partitions(spark, data):
    docs = table(spark, data, "documents")
    one = corpus_pipeline.near_duplicates(spark, docs.repartition(1), data)
    many = corpus_pipeline.near_duplicates(spark, docs.repartition(7), data)
    ids = lambda df: sorted(r["doc_id"] for r in df.select(F.col("doc_id")).collect())
    assert ids(one) == ids(many)
