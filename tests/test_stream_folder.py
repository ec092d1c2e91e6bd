"""The stream over a documents table that is a folder of files."""

import numpy as np
from checks.queries import QUERIES


def test_a_table_of_several_files_streams_like_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=4).tolist(), i % 10) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"python sql job {i}") for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(i, f"Skills: sql and docker\nProfile {i}", "en", "web", 20) for i in range(25)] + [(25, "", "en", "web", 0)]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    streamed, batch = (QUERIES[name](spark, str(tmp_path)) for name in ("stream_screen", "screen_pairs"))
    rows = sorted(map(str, batch.collect()))
    assert len(rows) > 26 and sorted(map(str, streamed.select(batch.columns).collect())) == rows
