"""The vectors that a screening ranks move as they are stored."""

import pytest

from sieveline.plans import screening


@pytest.mark.parametrize("docs_kind, jobs_kind, moved", [("float", "float", "float"), ("float", "double", "double"), ("double", "float", "double")])
def test_single_precision_stays_single(spark, monkeypatch, docs_kind, jobs_kind, moved):
    def rows(kind, key, vector, some):
        return spark.createDataFrame(some, f"{key} long, {vector} array<{kind}>")

    docs = rows(docs_kind, "doc_id", "embedding", [(1, [0.1, 0.9]), (2, [0.7, -0.3]), (3, None)])
    jobs = rows(jobs_kind, "job_id", "jd_embedding", [(1, [0.3, 0.2]), (2, None)])
    index = rows("float", "doc_id", "embedding", [(i, [0.1 * i, 1.0 - 0.2 * i]) for i in range(12)])
    asked, rank = [], screening.rank_by_cosine
    monkeypatch.setattr(screening, "rank_by_cosine", lambda queries, *more: asked.append(queries) or rank(queries, *more))
    with_lists, of_jobs = screening.with_rankings(docs, jobs, index, 2)
    assert [q.schema["embedding"].dataType.simpleString() for q in asked] == [f"array<{moved}>"]
    alone = rank(docs, index.withColumnRenamed("doc_id", "ranked_id"), 2, "doc_id", "ranked_id").collect()
    expected = {k: [r["ranked_id"] for r in sorted(alone, key=lambda r: r["rank"]) if r["doc_id"] == k] for k in (1, 2, 3)}
    got = {r["doc_id"]: [x["ranked_id"] for x in r["similar_docs"] or []] for r in with_lists.collect()}
    assert got == expected and [len(got[k]) for k in (1, 2, 3)] == [2, 2, 0]
    assert {r["job_id"]: len(r["jd_ranked_docs"] or []) for r in of_jobs.collect()} == {1: 2, 2: 0}
