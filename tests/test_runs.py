"""The end-to-end jobs, the joins behind them, and every query against its SQL counterpart."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks.fixtures import Tables
from checks.queries import QUERIES
from sieveline.operators.classifier import class_probabilities, train_classifier
from sieveline.operators.clustering import predict_clusters
from sieveline.operators.embedding import HashingEncoder, embed_chunks
from sieveline.operators.joins import hot_keys, hot_tables, skew_join
from sieveline.operators.ranking import load_cells, rank_by_cosine
from sieveline.plans import offline, screening
from sieveline.sources import artifacts
from sieveline.streaming import screening as stream

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def test_skew_join_keeps_every_row(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("long").alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    left = left.unionByName(spark.range(5000, 5200).select("id", F.lit(None).cast("long").alias("k")))
    assert [tuple(r) for r in hot_keys(left, "k", 10).collect()] == [(0, 4)]
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, skew_join(left, right, "k", how, "id", partitions=10).collect())) == plain


def test_hot_and_null_keys_do_not_meet_in_one_task(spark):
    """A third of the rows with one key and a third with none: the largest task stays near the mean."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    left = spark.range(30_000).select("id", key.cast("long").alias("k"))
    right = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = skew_join(left, right, "k", "left", "id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30_000 and max(sizes) < 3 * 30_000 / 20


WORDS = {
    "data": "python pandas statistics model analysis numbers chart",
    "web": "javascript css html page browser layout click",
    "ops": "docker linux server deploy cluster terraform pager",
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(90):
        label = list(WORDS)[i % 3]
        words = WORDS[label].split()
        text = " ".join(words[(i + j * (i % 5 + 1)) % 7] for j in range(12))
        rows.append((str(i), f"Summary\n{text}\nSkills\n{words[i % 7]}, {words[(i + 1) % 7]}\nExperience\n{i % 9} years {text}", label))
    return spark.createDataFrame(rows, "id string, doc_text string, label string")


@pytest.fixture(scope="module")
def built(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("build"))
    return folder, offline.build(corpus, folder, HashingEncoder(32), n_clusters=3)


def test_built_cells_rank_without_the_build(spark, built):
    """The stored cells of the build give the lists that its vectors give."""
    folder, build = built
    vectors = build.vectors.where("embedding is not null")
    queries = vectors.select(F.col("doc_id").alias("query_id"), "embedding").limit(9)
    from_store = rank_by_cosine(queries, load_cells(spark, f"{folder}/cells"), 4)
    assert sorted(map(tuple, from_store.collect())) == sorted(map(tuple, rank_by_cosine(queries, vectors, 4).collect()))


def test_hot_tables_count_all_keys_in_one_pass(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise(F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("n"),
    )
    found = hot_tables(rows, ["s", "n"], 8)
    assert [tuple(r) for r in found["s"].collect()] == [("a", 4)]
    assert sorted(map(tuple, found["n"].collect())) == [(0, 4), (1, 4)]
    assert hot_tables(spark.range(100), ["id"], 8)["id"].count() == 0
    assert hot_tables(rows.limit(0), ["s"], 8)["s"].count() == 0


def test_offline_build(spark, built):
    folder, result = built
    report = {(r["section"], r["name"]): r["value"] for r in result.report.collect()}
    assert report[("test_metrics", "accuracy")] >= 0.9
    assert report[("resume_index", "n_resumes")] == 90
    assert report[("clustering", "n_clusters")] == 3
    assert -1 <= report[("clustering", "silhouette_squared")] <= 1
    assert report[("classifier_report", "macro avg.support")] == 18
    assert artifacts.load_encoder_name(spark, f"{folder}/embedder") == "hashing"
    index = artifacts.read_index(spark, f"{folder}/index")
    assert index.count() == 90 and "label" not in index.columns
    written = spark.read.json(f"{folder}/report").first()["report"]
    assert written["test_metrics"]["accuracy"] == report[("test_metrics", "accuracy")]


def vectorised(folder, spark):
    model, kmeans = artifacts.load_models(f"{folder}/models")

    def add(df):
        return class_probabilities(model, embed_chunks(df, HashingEncoder(32)))

    return add, kmeans


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(1, "Skills:\npython, statistics\nExperience\n3 years data analysis"), (2, ""), (3, "Skills\ndocker linux")]
    prepared = screening.prepare_jobs(spark.createDataFrame(rows, "job_id int, jd_text string"))
    chunked = screening.preprocess(prepared, "jd_text")
    vectors = embed_chunks(chunked, HashingEncoder(32), out="jd_embedding")
    return vectors.withColumn("jd_embedding", F.when(F.col("clean_jd") != "", F.col("jd_embedding")))


def test_screening_from_text_to_report(spark, built, corpus, jobs):
    folder, _ = built
    add, kmeans = vectorised(folder, spark)
    docs = add(screening.prepare_documents(corpus.withColumnRenamed("id", "doc_id").drop("label")))
    decided = predict_clusters(kmeans, screening.decide_documents(docs))
    requests = corpus.select(F.col("id").alias("doc_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("job_id"))
    index = artifacts.read_index(spark, f"{folder}/index", "string")
    lost = spark.createDataFrame([("nobody", 1)], "doc_id string, job_id int")
    full = screening.screen(*screening.with_rankings(decided, jobs, index, 3), requests.union(lost), encoder="hashing")
    turned_away = full.where("reason is not null").collect()
    assert [(r["doc_id"], r["suitability"], r["match_strength"]) for r in turned_away] == [("nobody", None, None)]
    full = full.where("reason is null")
    assert full.where("explanation like '%in hashing embedding space%'").count() == 180
    rows = full.select("doc_id", "job_id", screening.report(full).alias("r")).collect()
    assert len(rows) == 360
    for row in rows:
        r = row["r"]
        screened, match = r["screening"], r["match"]
        assert 0 <= r["decision"]["confidence"] <= 1
        assert r["similar_docs"][0]["similarity"] == pytest.approx(1.0)
        if row["job_id"] in (2, 4):
            assert screened["alpha"] == 0.0 and screened["match_strength"] == "Weak Match"
            assert match["similarity"] == 0.0 and r["jd_ranked_docs"] is None
        else:
            assert len(r["jd_ranked_docs"]) == 3
            want = 0.7 * (match["similarity"] + 1) / 2 + 0.3 * screened["max_class_probability"]
            assert screened["suitability_score"] == pytest.approx(want)
    assert full.select(F.to_json(screening.report(full))).first()[0].startswith('{"screening":{"suitability_score"')


def test_stream_equals_batch(spark, built, corpus, jobs, tmp_path):
    folder, _ = built
    add, _ = vectorised(folder, spark)
    docs = corpus.select(F.col("id").alias("doc_id"), "doc_text")
    source = str(tmp_path / "arrivals")
    docs.withColumn("job_ids", F.array(F.lit(1), F.lit(2))).repartition(3).write.parquet(source)
    arrivals = stream.read_documents(spark, source, "doc_id string, doc_text string, job_ids array<int>")
    output, state = str(tmp_path / "out"), str(tmp_path / "state")
    columns = ("doc_id", "job_id", "suitability", "primary_domain", "confidence", "explanation")
    for _ in range(2):
        # The second run finds nothing new and must not write anything again.
        stream.run(
            arrivals, lambda batch: stream.screen_arrivals(batch, jobs, add).select(*columns), output, state
        ).awaitTermination()
    requests = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("job_id"))
    batch = screening.screen(screening.decide_documents(add(screening.prepare_documents(docs))), jobs, requests)
    got = sorted(map(str, spark.read.parquet(output).select(*columns).collect()))
    assert got == sorted(map(str, batch.select(*columns).collect())) and len(got) == 180


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data).toArrow()
    assert got.num_rows > 0
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)

    def rows(table):
        return sorted(zip(*[map(repr, table[c].to_pylist()) for c in columns]))

    assert rows(got) == rows(want)


def test_trained_models_on_the_given_vectors(spark, data):
    """What SQL cannot state: how well the fitted classifier does."""
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    scored = class_probabilities(train_classifier(vectors), vectors)
    hits = scored.agg(F.avg((F.get("ml_probs", F.lit(0))["class"] == F.col("label").cast("string")).cast("double"))).first()[0]
    assert hits > 0.3


def test_no_query_leaves_rows_out(spark, data):
    tables = Tables(spark, data)
    docs = tables.scan("documents").count()
    assert tables.screening_docs().count() == docs == tables.doc_vectors().count()
    assert tables.requests().select("doc_id").distinct().count() == docs
    assert tables.chunk_vecs().count() == tables.scan("embeddings").count()
