"""Embedding, pooling, ranking and clustering against small NumPy statements."""

import hashlib
import math
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.functions import vectors as V
from sieveline.operators import clustering, ranking
from sieveline.operators.embedding import (
    EmbeddingStore,
    HashingEncoder,
    ModelEncoder,
    embed_chunks,
    embed_chunks_stored,
    fingerprint,
    pool_chunks,
    text_key,
)
from sieveline.operators.ranking import rank_by_cosine


def test_fingerprint_and_keys(spark):
    df = spark.createDataFrame([("aé", None)], "a string, b string")
    row = df.select(
        fingerprint(F.col("a"), F.col("b")).alias("f"),
        text_key(F.col("a"), "m").alias("k"),
    ).first()
    assert row["f"] == hashlib.sha256("aé\0\0".encode()).hexdigest()
    assert row["k"] == "m::" + hashlib.sha256("aé\0".encode()).hexdigest() + "::normalize=True"


def test_cosine_and_norm(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    out = df.select(V.cosine(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()
    assert out[0][0] == pytest.approx(0.96) and out[0][1] == pytest.approx([0.6, 0.8])
    assert out[1][0] == 0.0 and out[1][1] == [0.0, 0.0]
    assert out[2][0] is None and out[2][1] is None


def hashed(text, dim):
    v = np.zeros(dim)
    token = ""
    for ch in text.lower() + " ":
        if ch.isalpha():
            token += ch
        elif token:
            v[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
            token = ""
    n = np.linalg.norm(v)
    return v / n if n else v


def test_hashing_encoder(spark):
    texts = ["Hello, world hello", "", None, "été 42 Été"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["embedding"] for r in HashingEncoder(16).encode(df, "t").orderBy("i").collect()]
    for text, v in zip(texts, got):
        assert v == pytest.approx(hashed(text or "", 16))


def test_model_encoder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(0, "abc"), (1, None)], "i int, t string")
    out = ModelEncoder("toy", load, batch_size=1).encode(df, "t").orderBy("i").collect()
    assert out[0]["embedding"] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    assert out[1]["embedding"] == pytest.approx([0.0, 1.0])


def test_pooling(spark):
    rows = [
        (1, "summary", [1.0, 0.0]),
        (1, "skills", [0.0, 1.0]),
        (1, "other", [9.0, 9.0]),
        (2, "experience", [0.0, 2.0]),
        (3, "other", [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, chunk string, embedding array<float>")
    got = {r["doc_id"]: r["embedding"] for r in pool_chunks(df).collect()}
    assert got[1] == pytest.approx([0.4 / math.sqrt(0.2), 0.2 / math.sqrt(0.2)])
    assert got[2] == pytest.approx([0.0, 1.0]) and got[3] == [0.0, 0.0]
    negative = pool_chunks(df, weights={"other": -1.0}, normalize=False)
    assert {r["doc_id"]: r["embedding"] for r in negative.collect()}[3] == [-1.0, -1.0]


def test_chunk_embedding_in_one_row(spark):
    rows = [(1, ("a b", "", "c")), (2, ("", "", "")), (3, ("", "x y", ""))]
    df = spark.createDataFrame(rows, "doc_id int, chunks struct<summary:string,experience:string,skills:string>")
    out = embed_chunks(df, HashingEncoder(8))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        raw = sum(
            w * (hashed(t, 8) if t else 0) for w, t in zip((0.4, 0.4, 0.2), (r["chunks"][0], r["chunks"][1], r["chunks"][2]))
        )
        size = np.linalg.norm(raw) if np.any(raw) else 1.0
        want = raw / size if np.any(raw) else np.zeros(8)
        assert r["embedding"] == pytest.approx(list(want))


def test_store_encodes_each_text_once(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    first = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "i int, t string")
    store.add(first, "t")
    assert store.read().count() == 11
    more = first.union(spark.createDataFrame([(99, "new")], "i int, t string"))
    new = store.missing(more, "t")
    assert [r["text_key"] for r in new.collect()] == [r[0] for r in spark.range(1).select(store.key(F.lit("new"))).collect()]
    assert "text#" not in new._jdf.queryExecution().executedPlan().toString()
    store.add(more, "t")
    assert store.read().count() == 12
    # A second writer that found the same texts missing writes them again.
    spark.read.parquet(store.path).write.mode("append").parquet(store.path)
    out = store.attach(more, "t")
    assert out.count() == 31 and out.filter("embedding is null").count() == 0 and out.columns == ["text_key", "i", "embedding"]


def keyed(store):
    return {r["text_key"]: r["embedding"] for r in store.read().collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compaction_settles_double_writes(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    assert store.compact() is False and store.vacuum() == 0
    texts = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "i int, t string")
    store.add(texts.where("i < 20"), "t")
    spark.read.parquet(store.path).write.mode("append").parquet(store.path)
    before = keyed(store)
    assert store.compact(4) and store.compact(4) is False
    assert keyed(store) == before and store.read().count() == 20
    assert "Aggregate" not in plan_of(store.read()) and "Exchange" not in plan_of(store.read())
    # A late second writer appends settled keys again; new texts come too.
    spark.read.parquet(store.files.folder(store.files.state().generation)).drop("bucket").write.mode("append").parquet(store.path)
    store.add(texts, "t")
    assert store.read().count() == 40 and store.missing(texts, "t").count() == 0
    found = keyed(store)
    assert store.compact(8) and keyed(store) == found and store.files.state().buckets == 8
    assert store.vacuum() > 0 and keyed(store) == found
    assert store.attach(texts, "t").where("embedding is not null").count() == 80


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    store.add(spark.range(200).select(F.concat(F.lit("t"), F.col("id")).alias("t")), "t")
    store.compact(16)
    batch = spark.createDataFrame([(1, "t7"), (2, "t7"), (3, "t90")], "i int, t string")
    out = store.attach(batch, "t", few=True)
    buckets = {r[0] for r in batch.select(store.key(F.col("t")).alias("text_key")).selectExpr("cast(pmod(xxhash64(text_key), 16) as int)").collect()}
    keys = batch.select(store.key(F.col("t")).alias("text_key"))
    read = store.read(keys)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan_of(read))
    whole = store.read().select("text_key", F.expr("pmod(xxhash64(text_key), 16)").cast("int").alias("b"))
    assert sorted(r["text_key"] for r in read.collect()) == sorted(r["text_key"] for r in whole.collect() if r["b"] in buckets)
    assert {r["i"]: r["embedding"] for r in out.collect()} == {r["i"]: r["embedding"] for r in store.attach(batch, "t").collect()}
    assert out.where("embedding is not null").count() == 3


def test_a_second_compaction_of_the_same_state_is_dropped(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    store.add(texts, "t")
    seen = store.files.state()
    assert store.compact()
    assert store.files.publish(seen, "generation-other", 1) is False
    assert store.read().count() == 3 and store.files.state().number == 1


def test_files_of_a_bucket_hold_a_filter_of_their_keys(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    store.add(spark.range(50).select(F.col("id").cast("string").alias("t")), "t")
    store.compact(2)
    files = glob.glob(f"{store.files.folder(store.files.state().generation)}/bucket=*/*.parquet")
    assert len(files) == 2
    for f in files:
        keys = pq.read_table(f, columns=["text_key"], partitioning=None)["text_key"].to_pylist()
        assert keys == sorted(keys)
        # What a file holds beside columns and footer is the filter and a small page index.
        meta = pq.read_metadata(f)
        chunks = sum(meta.row_group(0).column(i).total_compressed_size for i in range(meta.num_columns))
        assert os.path.getsize(f) - chunks - meta.serialized_size > 1_000


def test_stored_chunks_equal_encoded_ones(spark, tmp_path):
    rows = [(1, ("a b", "", "c")), (2, ("", "", "")), (3, ("", "x y", "a b"))]
    df = spark.createDataFrame(rows, "doc_id int, chunks struct<summary:string,experience:string,skills:string>")
    direct = {r["doc_id"]: r["embedding"] for r in embed_chunks(df, HashingEncoder(8)).collect()}
    store = EmbeddingStore(spark, str(tmp_path / "store"), HashingEncoder(8))
    for _ in range(2):
        stored = {r["doc_id"]: r["embedding"] for r in embed_chunks_stored(df, store).collect()}
        assert set(stored) == {1, 3} and all(v == pytest.approx(direct[k]) for k, v in stored.items())
    assert spark.read.parquet(store.path).count() == 3


def test_plug_in_loads_once_and_skips_empty_chunks(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def model(texts):
            with open(log, "a") as f:
                f.writelines(f"text {t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = [(1, ("a b", "", "c")), (2, ("", "", "")), (3, ("", "x y", ""))]
    df = spark.createDataFrame(rows, "doc_id int, chunks struct<summary:string,experience:string,skills:string>").coalesce(1)
    out = embed_chunks(df, ModelEncoder("toy", load, normalize=False))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: r["embedding"] for r in out.collect()}
    raw = np.array([0.4 * 3 + 0.2 * 1, 0.4 + 0.2])
    assert got[1] == pytest.approx(list(raw / np.linalg.norm(raw))) and got[2] == [0.0, 0.0]
    lines = open(log).read().split("\n")[:-1]
    assert lines.count("load") == 1 and sorted(x for x in lines if x != "load") == ["text a b", "text c", "text x y"]


def brute_top(queries, corpus, n):
    def unit(x):
        return x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))

    scores = np.round(unit(queries) @ unit(corpus).T, 9) + 0.0
    return {
        q: [(d, scores[q, d]) for d in sorted(range(len(corpus)), key=lambda d: (-scores[q, d], d))[:n]]
        for q in range(len(queries))
    }


@pytest.mark.parametrize("block", [65_536, 3])
@pytest.mark.parametrize("key", ["long", "string"])
def test_ranking_against_brute_force(spark, block, key):
    rng = np.random.default_rng(5)
    corpus = rng.integers(-2, 3, size=(60, 4)).astype(float)
    corpus[20:40] = corpus[0]
    corpus[50] = 0.0
    queries = np.vstack([rng.integers(-2, 3, size=(16, 4)), np.zeros((1, 4))]).astype(float)

    def name(i):
        return i if key == "long" else f"{i:03d}"

    c = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(corpus)], f"doc_id {key}, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    q = q.union(spark.createDataFrame([(99, None)], "query_id long, embedding array<double>"))
    got = {}
    for r in rank_by_cosine(q, c.repartition(5), 6, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["similarity"]))
    want = brute_top(queries, corpus, 6)
    assert set(got) == set(want)
    for i, rows in got.items():
        assert [(d, s) for _, d, s in sorted(rows)] == [(name(d), pytest.approx(s)) for d, s in want[i]]


def test_ranking_skips_cells(spark):
    """On well separated groups a query sees few of the blocks, and still gets the exact answer."""
    rng = np.random.default_rng(2)
    centres = np.eye(12) * 10
    corpus = np.concatenate([c + rng.normal(size=(50, 12)) * 0.1 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, embedding array<double>")
    queries = df.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id")
    cells = ranking.cut_into_cells(df)
    asked = queries.selectExpr("query_id as _q", "embedding as _v", "0.99D as _least")
    pairs = sum(ranking._routed(asked, cells, 5, later).count() for later in (False, True))
    assert pairs < 0.4 * 24 * len(cells.sizes)
    got = {}
    for r in rank_by_cosine(queries, cells, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    want = brute_top(corpus[::25], corpus, 5)
    assert {q: [d for _, d in sorted(rows)] for q, rows in got.items()} == {25 * q: [d for d, _ in rows] for q, rows in want.items()}


def grouped_vectors(spark, groups=12, size=50):
    rng = np.random.default_rng(2)
    corpus = np.concatenate([c + rng.normal(size=(size, groups)) * 0.1 for c in np.eye(groups) * 10])
    return corpus, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, embedding array<double>")


def lists_of(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    return {q: [d for _, d in sorted(rows)] for q, rows in got.items()}


def test_stored_cells_rank_alike_and_are_read_in_part(spark, tmp_path):
    """A loaded index gives the same lists; one query reads only the partitions of the upper pivots it needs."""
    corpus, df = grouped_vectors(spark)
    folder = str(tmp_path / "cells")
    ranking.cut_into_cells(df, folder=folder, copies=5)
    loaded = ranking.load_cells(spark, folder)
    queries = df.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id")
    want = brute_top(corpus[::25], corpus, 5)
    assert lists_of(rank_by_cosine(queries, loaded, 5)) == {25 * q: [d for d, _ in rows] for q, rows in want.items()}
    asked = queries.limit(1).selectExpr("query_id as _q", "embedding as _v")
    tops, _ = ranking._demand(ranking._routed(asked, loaded, 5, False))
    assert 0 < len(tops) < len(loaded.table.tree.upper)
    one = rank_by_cosine(queries.limit(1), loaded, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_top#", plan)
    with pytest.raises(ValueError):
        rank_by_cosine(queries, loaded, 6)


def test_copies_are_collapsed_before_the_corpus_is_cut(spark):
    """A vector that most rows share takes as many rows as a list can show, and ties go to the least keys."""
    rng = np.random.default_rng(6)
    corpus = np.vstack([np.ones((900, 3)), rng.normal(size=(60, 3))])
    keys = rng.permutation(len(corpus)).tolist()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, corpus)], "doc_id long, embedding array<double>").repartition(4)
    cells = ranking.cut_into_cells(df, copies=7)
    assert cells.sizes.sum() == 67
    ordered = corpus[np.argsort(keys)]
    queries = df.where("doc_id % 90 = 0").withColumnRenamed("doc_id", "query_id")
    want = brute_top(ordered[::90], ordered, 7)
    assert lists_of(rank_by_cosine(queries, cells, 7)) == {90 * q: [d for d, _ in rows] for q, rows in want.items()}


def test_a_popular_block_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERIES", 10)
    corpus, df = grouped_vectors(spark, 3, 40)
    queries = df.selectExpr("doc_id as query_id", "embedding")
    cells = ranking.cut_into_cells(df)
    asked = queries.selectExpr("query_id as _q", "embedding as _v")
    assert ranking._demand(ranking._routed(asked, cells, 5, False))[1]
    want = brute_top(corpus, corpus, 5)
    assert lists_of(rank_by_cosine(queries, cells, 5)) == {q: [d for d, _ in rows] for q, rows in want.items()}


def test_placing_meets_no_more_than_a_few_branches():
    """Vectors are compared with the upper pivots and with what hangs below a few of them."""
    rng = np.random.default_rng(0)
    tree = ranking.PivotTree.of(ranking.unit_rows(rng.normal(size=(400, 8))))
    vectors = ranking.unit_rows(rng.normal(size=(1000, 8)))
    cell, angle = tree.place(vectors)
    assert np.allclose(np.cos(angle), (vectors * tree.pivots[cell]).sum(axis=1), atol=1e-6)
    table = ranking.CellTable(tree, np.zeros(400), np.bincount(cell, minlength=400), np.zeros(400, int), np.ones(400, int))
    rows, cells = table.nearest(vectors, ranking._angles(vectors, tree.upper), 3)
    assert np.bincount(rows, table.sizes[cells]).min() >= 3


def test_ranking_of_nothing(spark):
    schema = "query_id long, embedding array<double>"
    q = spark.createDataFrame([(1, [1.0])], schema)
    c = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")
    assert rank_by_cosine(q, c.limit(0)).count() == 0
    assert rank_by_cosine(q.limit(0), c).count() == 0
    assert rank_by_cosine(q, c, top_n=-3).count() == 0
    assert rank_by_cosine(q, c, top_n=0).count() == 0
    assert rank_by_cosine(q, c, top_n=9).count() == 1


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        same = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == k].mean() for k in set(labels) if k != labels[i])
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [65_536, 9])
def test_silhouette(spark, block):
    rng = np.random.default_rng(1)
    labels = np.array([0] * 20 + [5] * 15 + [7] * 4 + [9])
    x = rng.normal(size=(40, 3)) + labels[:, None] * 0.2
    df = spark.createDataFrame(
        [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x))],
        "vec_id long, cluster_id int, embedding array<double>",
    )
    row = clustering.silhouette(df, 4, block=block).first()
    assert row["silhouette"] == pytest.approx(brute_silhouette(x, labels)) and row["n"] == 40
    assert clustering.silhouette(df, 1).first()["silhouette"] == -1.0
    assert clustering.silhouette(df, 41).first()["silhouette"] == -1.0
    assert clustering.silhouette(df.withColumn("cluster_id", F.lit(0)), 4).first()["silhouette"] == -1.0
    assert -1 <= clustering.silhouette(df, 4, squared=True).first()["silhouette"] <= 1


def test_silhouette_of_copies(spark):
    """Copies weigh as many points as they are, in one cluster and across two, whatever their ids are."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 4)), np.repeat(rng.normal(size=(2, 4)), 40, axis=0)])
    labels = np.concatenate([np.arange(30) % 3, np.arange(80) % 2])
    df = spark.createDataFrame(
        [(None if i % 2 else 1, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x))],
        "vec_id long, cluster_id int, embedding array<double>",
    )
    for block in (7, 65_536):
        row = clustering.silhouette(df, 3, block=block).first()
        assert row["silhouette"] == pytest.approx(brute_silhouette(x, labels), abs=1e-6) and row["n"] == 110
    empty = clustering.silhouette(df.limit(0), 3).first()
    assert empty["silhouette"] == -1.0 and empty["n"] == 0


def test_each_pair_of_groups_meets_once(spark):
    """A vector goes to as many cells as there are groups, about the root of the cells, and a distance counts for both its points."""
    points = clustering._weighted_points(spark.createDataFrame([(i % 2, [float(i)]) for i in range(60)], "_k int, _v array<double>"))
    for groups in (1, 2, 5):
        sums = {r["_id"]: list(r["sums"]) for r in clustering._sums_on_grid(points, 2, groups).collect()}
        value = {r["_id"]: r["_v"][0] for r in points.collect()}
        assert sums.keys() == value.keys()
        for i, v in value.items():
            assert sums[i] == pytest.approx([sum(abs(v - w) for w in range(k, 60, 2)) for k in (0, 1)])
    assert clustering._groups(10, 65_536, 8) == 3 and clustering._groups(10**6, 65_536, 8) == 16


def test_a_distance_is_computed_once(monkeypatch):
    computed = []
    plain = clustering.squared_distances
    monkeypatch.setattr(clustering, "squared_distances", lambda x, y: computed.append(len(x) * len(y)) or plain(x, y))
    cell = clustering._Cell(False, 1)
    cell.hold(pa.array([1, 2]), np.array([[0.0], [3.0]]), np.array([[2.0], [1.0]]))
    assert cell.settle() and cell.meet(np.array([[1.0]]), np.array([[5.0]])).tolist() == [[4.0]]
    assert cell.held_sums()[1].tolist() == [[5.0], [10.0]] and sum(computed) == 2


def test_assignment_and_profile(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "i int, embedding array<double>")
    out = clustering.assign_clusters(df, [3, 8], np.array([[0.0, 0.0], [1.0, 1.0]]))
    got = {r["i"]: r["cluster_id"] for r in out.collect()}
    # Row 4 is as far from both; the earlier centroid wins.
    assert got == {1: 3, 2: 8, 3: None, 4: 3}
    profile = {r["cluster_id"]: (r["n"], r["centroid"]) for r in clustering.cluster_profile(out.filter("i <> 3"), "cluster_id").collect()}
    assert profile == {3: (2, [0.25, 0.75]), 8: (1, [5.0, 5.0])}


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, size=(20, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, embedding array<double>")
    model = clustering.train_kmeans(df, 3)
    out = clustering.predict_clusters(model, df.union(spark.createDataFrame([(999, None)], df.schema))).collect()
    groups = [{r["cluster_id"] for r in out if a <= r["i"] < a + 20} for a in (0, 20, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert [r["cluster_id"] for r in out if r["i"] == 999] == [None]


def test_a_query_moves_once_per_block_where_no_cell_can_be_skipped(spark):
    """Vectors without structure reach nearly all cells; what is shuffled grows with blocks, not with cells."""
    rng = np.random.default_rng(8)
    corpus = rng.normal(size=(2000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, embedding array<double>")
    queries = df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    cells = ranking.cut_into_cells(df)
    asked = queries.selectExpr("query_id as _q", "embedding as _v", "0.2D as _least")
    upper = len(cells.table.tree.upper)
    assert len(cells.sizes) > 5 * upper
    assert ranking._routed(asked, cells, 5, True).count() <= 200 * upper
    want = brute_top(corpus[::10], corpus, 5)
    assert lists_of(rank_by_cosine(queries, cells, 5)) == {10 * q: [d for d, _ in rows] for q, rows in want.items()}


def test_cells_share_blocks_of_bounded_size():
    tree = ranking.PivotTree.of(ranking.unit_rows(np.random.default_rng(1).normal(size=(100, 6))))
    sizes = np.random.default_rng(2).integers(0, 40, size=100)
    sizes[[3, 50]] = 250
    first, blocks = ranking._numbered(tree, sizes, 100)
    table = ranking.CellTable(tree, np.zeros(100), sizes, first, blocks)
    rows, above = np.zeros(len(table.tops())), np.repeat(np.arange(10), np.diff(tree.edges))
    for cell in np.flatnonzero(sizes):
        own, _ = table.blocks_of(np.array([cell]))
        assert (table.tops()[own] == above[cell]).all()
        rows[own] += sizes[cell] / len(own)
    assert rows.sum() == sizes.sum() and 0 < rows.min() and rows.max() <= 100


def test_lists_of_documents_and_jobs_move_vectors_once_per_block(spark, monkeypatch):
    """The ranking of a whole screening run on vectors without structure: few routes, exact lists."""
    from sieveline.plans import screening

    rng = np.random.default_rng(11)
    corpus = rng.normal(size=(1500, 24))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, embedding array<double>")
    docs, jobs = index.where("doc_id % 20 = 0"), index.where("doc_id % 75 = 1").selectExpr("doc_id as job_id", "embedding as jd_embedding")
    routed, plain = [], ranking._routed
    monkeypatch.setattr(ranking, "_routed", lambda *a, **k: routed.append(plain(*a, **k)) or routed[-1])
    cells = ranking.cut_into_cells(index, copies=3)
    docs, jobs = screening.with_rankings(docs, jobs, cells, 3)
    most = 95 * len(cells.table.tree.upper)
    assert len(cells.sizes) > 5 * len(cells.table.tree.upper) and max(r.count() for r in routed) <= most
    want = brute_top(corpus, corpus, 3)
    for rows, key, lists in ((docs, "doc_id", "similar_docs"), (jobs, "job_id", "jd_ranked_docs")):
        assert {r[key]: [e["ranked_id"] for e in r[lists]] for r in rows.collect()} == {r[key]: [d for d, _ in want[r[key]]] for r in rows.collect()}
