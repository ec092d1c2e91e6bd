"""Artifacts of the offline build: corpus index, models, encoder metadata, report."""

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.ontology import Ontology
from sieveline.operators.embedding import DEFAULT_MODEL

INDEX_COLUMNS = ["doc_id", "embedding", "cluster_id"]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_index(df: DataFrame, path: str) -> None:
    """The scoring index: id, vector, cluster. Labels are left out on purpose.

    The rebalance step gathers each cluster into files of even size and splits a large cluster
    over several tasks.
    """
    even = df.select(INDEX_COLUMNS).hint("rebalance", F.col("cluster_id"))
    even.write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def read_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The index with the ids it was written with, or an empty one where none was written.

    ``id_type`` is the type of the ids of an empty index.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"doc_id {id_type}, embedding array<double>, cluster_id int")
    written = spark.read.parquet(path)
    return written.select("doc_id", F.col("embedding").cast("array<double>"), F.col("cluster_id").cast("int"))


def save_models(path: str, classifier: PipelineModel, kmeans: KMeansModel) -> None:
    classifier.write().overwrite().save(f"{path}/classifier")
    kmeans.write().overwrite().save(f"{path}/kmeans")


def load_models(path: str) -> tuple[PipelineModel, KMeansModel]:
    return PipelineModel.load(f"{path}/classifier"), KMeansModel.load(f"{path}/kmeans")


def save_encoder_name(spark: SparkSession, path: str, name: str) -> None:
    spark.createDataFrame([(name,)], "embedding_model string").write.mode("overwrite").json(path)


def load_encoder_name(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        return DEFAULT_MODEL
    row = spark.read.schema("embedding_model string").json(path).first()
    return (row and row[0]) or DEFAULT_MODEL


# Rows of an ontology that may stand in a plan; larger ones are joined (operators/terms.py).
ONTOLOGY_ROWS = 10_000


def load_ontology(domain_skill: DataFrame, alias: DataFrame) -> Ontology:
    """The ontology tables as one object for the row-wise expressions.

    A curated list of at most ``ONTOLOGY_ROWS`` rows, read in domain and skill order; anything
    larger is refused.
    """
    for part in (domain_skill, alias):
        if part.limit(ONTOLOGY_ROWS + 1).count() > ONTOLOGY_ROWS:
            raise ValueError(f"more than {ONTOLOGY_ROWS} ontology rows: use operators.terms")
    domains: dict[str, list[str]] = {}
    for r in domain_skill.orderBy("domain_pos", "skill_pos").collect():
        members = domains.setdefault(r["domain"], [])
        if r["skill"] is not None:
            members.append(r["skill"])
    return Ontology(domains, {r["alias"]: r["canonical"] for r in alias.collect()})


def report_rows(section: str, df: DataFrame, name: str | None = None) -> DataFrame:
    """A metric table in long form ``section, name, value``; ``name`` is the row-key column."""
    values = [c for c in df.columns if c != name]
    label = F.lit("") if name is None else F.concat(F.col(name).cast("string"), F.lit("."))
    entries = F.array(
        *[F.struct(F.concat(label, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in values]
    )
    return df.select(F.lit(section).alias("section"), F.explode(entries).alias("e")).select("section", "e.*")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document: sections of metrics. The rows are metrics, so few by nature."""
    sections = rows.groupBy("section").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metrics")
    )
    report = sections.agg(F.map_from_entries(F.collect_list(F.struct("section", "metrics"))).alias("report"))
    report.coalesce(1).write.mode("overwrite").json(path)
