"""Corpus and table readers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.bytes import decode_text
from sieveline.operators.corpus import MISSING_MARKS, normalize_corpus
from sieveline.sources.csv_splits import csv_records


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table, split as the session's file settings say.

    A table that sits in one row group cannot be split by a scan; who knows that may ask for a
    number of partitions, to which the rows are then dealt.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def read_labeled_csv(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """A labelled corpus with either accepted header, as ``id, doc_text, label``.

    Columns are read as text by header name. Quoted cells may span lines, so a file is read by one
    task; with ``split`` it is read by as many as it has splits, at the price of two passes, which a
    well-formed large file is worth (``csv_splits``).
    """
    if split:
        return normalize_corpus(csv_records(spark, path, "_number"), MISSING_MARKS, "_number")
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "inferSchema": False}
    return normalize_corpus(spark.read.options(**options).csv(path), MISSING_MARKS)


def read_text_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``path, doc_text`` of whole files with the charset fallback."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_text(F.col("content"), encoding).alias("doc_text"))


ONTOLOGY_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField(
            "domains",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("first", T.LongType())]),
            ),
        ),
        T.StructField("skill_aliases", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_ontology_tables(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """``domain, domain_pos, skill_pos, skill`` and ``alias, canonical`` from JSON.

    Missing keys mean empty; a domain without skills keeps one row with a null skill. One document
    per file, or one per line with ``multi_line=False``. A domain may be cut into several pieces,
    each with the place of its ``first`` skill.
    """
    raw = spark.read.schema(ONTOLOGY_SCHEMA).json(path, multiLine=multi_line)
    domains = raw.select(F.posexplode("domains").alias("domain_pos", "domain", "body")).select(
        "domain", "domain_pos", F.coalesce("body.first", F.lit(0)).alias("_first"), F.posexplode_outer("body.skills").alias("_at", "skill")
    )
    domains = domains.select("domain", "domain_pos", (F.col("_first") + F.col("_at")).alias("skill_pos"), "skill")
    aliases = raw.select(F.explode("skill_aliases").alias("alias", "canonical"))
    return domains, aliases


def all_skills(domain_skill: DataFrame) -> DataFrame:
    return domain_skill.filter(F.col("skill").isNotNull()).select(F.lower("skill").alias("skill")).distinct()
