"""The offline build: corpus in; vectors, models, index and evaluation report out."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import classifier, clustering, metrics
from sieveline.operators.embedding import EmbeddingStore, HashingEncoder, embed_chunks, embed_chunks_stored
from sieveline.operators.ranking import cut_into_cells
from sieveline.plans.screening import preprocess
from sieveline.sources import artifacts


@dataclass
class Build:
    vectors: DataFrame
    split: DataFrame
    model: PipelineModel
    kmeans: KMeansModel
    predictions: DataFrame
    report: DataFrame


def long_predictions(model: PipelineModel, df: DataFrame, label: str = "label") -> DataFrame:
    """``doc_id, y_true, class, p`` for the metric operators."""
    scored = classifier.class_probabilities(model, df)
    return scored.select("doc_id", F.col(label).alias("y_true"), F.explode_outer("ml_probs").alias("r")).select(
        "doc_id", "y_true", "r.class", "r.p"
    )


def evaluation_report(
    results: DataFrame, quality: DataFrame, n_clusters: int, index_size: DataFrame, quality_name: str = "silhouette_score"
) -> DataFrame:
    """``section, name, value`` of everything the build reports."""
    report = metrics.class_report(metrics.confusion_counts(results))
    parts = [
        artifacts.report_rows("test_metrics", metrics.metrics_summary(results)),
        artifacts.report_rows("classifier_report", report, "class"),
        artifacts.report_rows("classifier_report", metrics.report_averages(report), "average"),
        artifacts.report_rows(
            "clustering",
            quality.select(
                F.col("silhouette").alias(quality_name), F.lit(float(n_clusters)).alias("n_clusters")
            ),
        ),
        artifacts.report_rows("resume_index", index_size),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(
    corpus: DataFrame,
    folder: str,
    encoder=None,
    n_clusters: int = clustering.N_CLUSTERS,
    seed: int = classifier.SEED,
    exact_silhouette: bool = False,
    store: EmbeddingStore | None = None,
) -> Build:
    """Runs the whole build over ``id, doc_text, label`` and writes its artifacts below ``folder``.

    The vectors are written once because the classifier, the clustering and the index all read
    them; writing also ends the lineage, so a lost executor re-reads files and encodes nothing.
    The report has the one-pass silhouette with squared distance as ``silhouette_squared``;
    ``exact_silhouette`` asks for the Euclidean one, which compares all pairs. With a ``store``,
    chunk texts that it holds are not encoded again.
    """
    spark = corpus.sparkSession
    encoder = encoder or HashingEncoder()
    ready = preprocess(corpus.withColumnRenamed("id", "doc_id"), "doc_text")
    ready = ready.select("doc_id", "label", "chunks")
    if store is None:
        embedded = embed_chunks(ready, encoder)
    else:
        encoder = store.encoder
        embedded = ready.join(embed_chunks_stored(ready, store), "doc_id", "left")
    embedded.select("doc_id", "label", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    artifacts.save_encoder_name(spark, f"{folder}/embedder", encoder.name)

    split = classifier.stratified_split(vectors, "label", "doc_id", seed)
    model = classifier.train_classifier(split.filter(F.col("split") == "train").drop("split"))
    predictions = long_predictions(model, split.filter(F.col("split") == "test"))
    results = metrics.outcomes(predictions)

    kmeans = clustering.train_kmeans(vectors, n_clusters, seed)
    clustered = clustering.predict_clusters(kmeans, vectors)
    quality = clustering.silhouette(clustered, n_clusters, squared=not exact_silhouette)
    artifacts.save_models(f"{folder}/models", model, kmeans)
    artifacts.write_index(clustered, f"{folder}/index")
    cut_into_cells(vectors, folder=f"{folder}/cells")  # load_cells gives them back, ready to be ranked

    index_size = vectors.agg(F.count(F.lit(1)).alias("n_resumes"))
    name = "silhouette_score" if exact_silhouette else "silhouette_squared"
    report = evaluation_report(results, quality, n_clusters, index_size, name)
    artifacts.write_report(report, f"{folder}/report")
    return Build(vectors, split, model, kmeans, predictions, report)
