"""The screening run: documents and job descriptions in, explained and scored reports out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import rules
from sieveline.functions.sections import build_chunks, chunk_lengths, extract_sections
from sieveline.functions.skills import domain_evidence, skills_in
from sieveline.functions.text import clean_text
from sieveline.ontology import STANDARD, Ontology
from sieveline.operators.classifier import max_probability, top_classes
from sieveline.operators.corpus import split_blank
from sieveline.operators.decisions import decide
from sieveline.operators.embedding import DEFAULT_MODEL
from sieveline.operators.joins import hot_tables, skew_join
from sieveline.operators.matching import match_columns, rank_lists
from sieveline.operators.ranking import Cells, cut_into_cells, rank_by_cosine
from sieveline.operators.ranking import _settled as settled

# Fixed value: length of the ranked lists in a report.
LIST_LENGTH = 5

UNKNOWN_DOCUMENT = "Document is unknown or has no text"

JOB_COLUMNS = ("job_id", "clean_jd", "jd_skills", "jd_embedding", "jd_ranked_docs")


def preprocess(df: DataFrame, text: str) -> DataFrame:
    """Adds ``clean_text`` and ``chunks``; each text is cleaned once and read by all that follows."""
    return df.withColumn("clean_text", clean_text(F.col(text))).withColumn(
        "chunks", build_chunks(extract_sections(F.col("clean_text")))
    )


def accepted(docs: DataFrame, text: str = "doc_text") -> DataFrame:
    """Documents with text; a request for a blank one is answered with a reason."""
    return split_blank(docs, text)[0]


def prepare_documents(docs: DataFrame, ontology: Ontology = STANDARD, text: str = "doc_text") -> DataFrame:
    """Text-side columns of each document: clean text, chunk lengths, skills, domain evidence."""
    return (
        preprocess(docs, text)
        .withColumn("skills", skills_in(F.col("clean_text"), ontology))
        .withColumn("evidence", domain_evidence(F.col("skills"), ontology))
        .withColumn("chunk_lengths", chunk_lengths(F.col("chunks")))
    )


def prepare_jobs(jobs: DataFrame, ontology: Ontology = STANDARD, text: str = "jd_text") -> DataFrame:
    cleaned = jobs.withColumn("clean_jd", clean_text(F.col(text)))
    return cleaned.withColumn("jd_skills", skills_in(F.col("clean_jd"), ontology))


def decide_documents(docs: DataFrame) -> DataFrame:
    """Decision columns; the texts are dropped here and never reach a join."""
    return (
        decide(docs)
        .withColumn("top_domains", top_classes(F.col("ml_probs")))
        .withColumn("max_p", max_probability(F.col("ml_probs")))
        .drop("doc_text", "clean_text", "chunks")
    )


def score_pairs(
    pairs: DataFrame, alpha: float = rules.ALPHA, beta: float = rules.BETA, encoder: str = DEFAULT_MODEL
) -> DataFrame:
    """Adds the match record, the suitability score and the strength band to (document, job) rows."""
    has_job = F.coalesce(F.col("clean_jd"), F.lit("")) != ""
    matched = match_columns(pairs, encoder=encoder)
    scored = matched.withColumns(
        {
            "alpha": rules.alpha_for(has_job, alpha),
            "beta": F.lit(float(beta)),
            "similarity_component": rules.similarity_component(F.col("similarity")),
            "suitability": rules.suitability(F.col("similarity"), F.col("max_p"), has_job, alpha, beta),
        }
    )
    return scored.withColumn("match_strength", rules.match_strength(F.col("suitability")))


def screen(
    docs: DataFrame,
    jobs: DataFrame,
    requests: DataFrame,
    alpha: float = rules.ALPHA,
    beta: float = rules.BETA,
    encoder: str = DEFAULT_MODEL,
) -> DataFrame:
    """Scores every requested (doc_id, job_id) pair.

    ``docs`` comes from ``decide_documents``, ``jobs`` from ``prepare_jobs`` with a
    ``jd_embedding``. Documents are scored once, however many jobs ask for them. A job that
    attracts a large share of all requests, or a document that makes one, is spread over several
    partitions. A request for a document that is not there, or that was turned away as blank,
    keeps its row with a ``reason`` and without scores.
    """
    known = docs.withColumn("_known", F.lit(True))
    hot = hot_tables(requests, ["doc_id", "job_id"])  # counted once for both joins
    with_docs = skew_join(requests, known, "doc_id", "left", "job_id", hot=hot["doc_id"])
    side = jobs.select([c for c in JOB_COLUMNS if c in jobs.columns])
    pairs = skew_join(with_docs, side, "job_id", "left", "doc_id", hot=hot["job_id"])
    scored = score_pairs(pairs, alpha, beta, encoder)
    unknown = F.col("_known").isNull()
    new = [c for c in scored.columns if c not in pairs.columns]
    kept = scored.withColumns({c: F.when(~unknown, F.col(c)) for c in new})
    return kept.withColumn("reason", F.when(unknown, F.lit(UNKNOWN_DOCUMENT))).drop("_known")


def with_rankings(
    docs: DataFrame, jobs: DataFrame, index: DataFrame | Cells, n: int = LIST_LENGTH
) -> tuple[DataFrame, DataFrame]:
    """Documents and jobs with the index documents closest to each.

    The lists are attached before the requests are joined, so they are made once per document and
    job and travel with them. Ranking reads the vectors more than once (to size its blocks), so
    pass frames whose vectors are stored rather than freshly encoded.
    """
    cells = index if isinstance(index, Cells) else cut_into_cells(index, copies=n)
    d_type, j_type = docs.schema["doc_id"].dataType, jobs.schema["job_id"].dataType
    who = lambda d, j: F.struct(d.cast(d_type).alias("doc_id"), j.cast(j_type).alias("job_id")).alias("who")
    # Documents and jobs are ranked together: the index is met once.
    # Vectors move in single precision if all are; the products are in doubles either way.
    kinds = {docs.schema["embedding"].dataType.simpleString(), jobs.schema["jd_embedding"].dataType.simpleString()}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    asked = docs.select(who(F.col("doc_id"), F.lit(None)), F.col("embedding").cast(kind), F.lit(0).alias("side"))
    asked = asked.union(jobs.select(who(F.lit(None), F.col("job_id")), F.col("jd_embedding").cast(kind), F.lit(1)))
    asked = asked.withColumn("who", F.struct("side", "who.doc_id", "who.job_id")).drop("side")
    lists = settled(_lists(asked, cells, n, "who", "ranked"), "ranked-lists")
    of_docs = lists.where("who.side = 0").select("who.doc_id", F.col("ranked").alias("similar_docs"))
    of_jobs = lists.where("who.side = 1").select("who.job_id", F.col("ranked").alias("jd_ranked_docs"))
    return docs.join(of_docs, "doc_id", "left"), jobs.join(of_jobs, "job_id", "left")


def _lists(queries: DataFrame, index: Cells, n: int, key: str, out: str) -> DataFrame:
    return rank_lists(rank_by_cosine(queries, index, n, key, "ranked_id"), key, "ranked_id", out)


def rank_documents(docs: DataFrame, index: Cells, n: int = LIST_LENGTH) -> DataFrame:
    """Documents with their ``similar_docs``."""
    return docs.join(_lists(docs.select("doc_id", "embedding"), index, n, "doc_id", "similar_docs"), "doc_id", "left")


def rank_for_jobs(jobs: DataFrame, index: Cells, n: int = LIST_LENGTH) -> DataFrame:
    """Jobs with their ``jd_ranked_docs``."""
    queries = jobs.select("job_id", F.col("jd_embedding").alias("embedding"))
    return jobs.join(_lists(queries, index, n, "job_id", "jd_ranked_docs"), "job_id", "left")


def report(scored: DataFrame) -> Column:
    """The nested report of one pair; lists and cluster appear when the columns are there."""
    have = set(scored.columns)
    optional = [F.col(c) for c in ("cluster_id", "jd_ranked_docs", "similar_docs") if c in have]
    return F.struct(
        F.struct(
            F.col("suitability").alias("suitability_score"),
            "match_strength",
            "top_domains",
            "alpha",
            "beta",
            F.col("similarity").alias("similarity_raw"),
            "similarity_component",
            F.col("max_p").alias("max_class_probability"),
        ).alias("screening"),
        F.col("chunk_lengths").alias("chunks"),
        F.struct(
            "primary_domain",
            "secondary_domains",
            "confidence",
            F.col("trace").alias("explanation_trace"),
            "ml_probs",
            F.map_from_entries(
                F.transform(F.col("evidence"), lambda e: F.struct(e["domain"], e["score"]))
            ).alias("skill_domain_scores"),
        ).alias("decision"),
        F.struct("similarity", "matched_skills", "missing_skills", "explanation").alias("match"),
        F.col("skills").alias("resume_skills"),
        *optional,
    )
