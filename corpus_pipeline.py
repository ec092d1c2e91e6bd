"""From raw documents to token files: five stages, each written as Parquet and read by the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bytecnn, decontaminate, mixing, simhash, tokenfiles
from sieveline.llm.common import cut
from sieveline.llm.queries import table

#: SQL cannot express the network, the tokenizer or the reachability of links.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at or above the threshold."""
    net = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    return bytecnn.score(docs, net, keep=bytecnn.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their sources, repeated where a source has too few."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns what reading them back gives for each document."""
    return tokenfiles.token_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
