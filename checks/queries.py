"""One query per operator, over the whole given tables."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import CLASS_NAMES, DOC_TEXT, Tables
from sieveline.functions import rules
from sieveline.functions import sections as S
from sieveline.functions import skills as K
from sieveline.functions import text as X
from sieveline.functions import vectors as V
from sieveline.functions.bytes import decode_text
from sieveline.ontology import STANDARD
from sieveline.operators import classifier, clustering, corpus, metrics
from sieveline.operators.decisions import decide
from sieveline.operators.embedding import EmbeddingStore, HashingEncoder, ModelEncoder, embed_chunks, fingerprint, pool_chunks
from sieveline.operators.joins import hot_tables, skew_join
from sieveline.operators.matching import match_columns, shortlist
from sieveline.operators.ranking import cut_into_cells, load_cells, rank_by_cosine
from sieveline.operators.terms import skills_by_automata, term_table
from sieveline.plans import screening
from sieveline.plans.offline import evaluation_report as build_report
from sieveline.session import shared_folder
from sieveline.sources import artifacts, files
from sieveline.streaming import screening as stream

QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def r6(c):
    """Six decimals, halves up, without a negative zero."""
    return F.floor(c * 1000000 + 0.5) / 1000000


def joined(c, sep="|"):
    return F.array_join(c, sep)


def text_query(fn):
    return lambda t, table="documents", key="doc_id", text="text": t.read(table).select(
        key, fn(F.col(text)).alias("out")
    )


# ---- sources and sinks ------------------------------------------------------------------------


def _labeled(t: Tables) -> DataFrame:
    labels = t.scan("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("Category"))
    return t.scan("documents").select("doc_id", "text").join(labels, "doc_id", "left")


@query
def corpus_normalize(t):
    keyed = _labeled(t).select(F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), "Category")
    return corpus.normalize_corpus(keyed)


@query
def corpus_from_csv(t):
    """The labelled documents written as CSV, line breaks in cells included, and read back by splits."""
    folder = shared_folder(t.spark, "csv")
    rows = _labeled(t).select(F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), "Category")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "quoteAll": True}
    rows.write.options(header=True, **kept).csv(folder)
    return files.read_labeled_csv(t.spark, folder, split=True)


@query
def assign_row_ids(t):
    return corpus.assign_row_ids(t.scan("documents").select("doc_id"), "doc_id")


@query
def assemble_pages(t):
    return corpus.assemble_pages(t.scan("conversations"), "conv_id", "turn", "text")


@query
def decode_text_files(t):
    """Texts that fit Latin-1 come in as Latin-1 bytes, the others as UTF-8."""
    text = F.col("text")
    narrow = text.rlike(r"^[\x00-\x7f\x{a0}-\x{ff}]*$")
    data = F.when(narrow, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return t.read("documents").select("doc_id", decode_text(data).alias("doc_text"))


@query
def ontology_tables(t):
    """An ontology taken from the part table, written as JSON and read back."""
    names = t.scan("part").select(F.struct(F.col("p_brand").alias("domain"), F.col("p_name").alias("skill")).alias("k")).distinct()
    placed = corpus.assign_row_ids(names, "k", "at").select("k.*", F.col("at").cast("long").alias("at"))
    starts = placed.groupBy("domain").agg(F.min("at").alias("start"))
    rows = placed.join(starts, "domain").select("domain", "skill", (F.col("at") - F.col("start")).alias("pos"))
    # A line holds at most a thousand skills of a domain, however many the domain has.
    pieces = rows.groupBy("domain", F.floor(F.col("pos") / 1000).alias("piece")).agg(
        F.struct(F.sort_array(F.collect_list("skill")).alias("skills"), F.min("pos").alias("first")).alias("body")
    )
    folder = shared_folder(t.spark, "ontology")
    pieces.select(F.create_map("domain", "body").alias("domains")).write.json(folder)
    domains, _ = files.read_ontology_tables(t.spark, folder, multi_line=False)
    return domains.select("domain", F.col("skill_pos").cast("long").alias("skill_pos"), "skill")


@query
def corpus_index(t):
    labels, centers = t.label_centroids
    clustered = clustering.assign_clusters(t.doc_vectors(), labels, centers)
    folder = shared_folder(t.spark, "index")
    artifacts.write_index(clustered, folder)
    index = artifacts.read_index(t.spark, folder)
    return index.select(
        "doc_id",
        F.col("cluster_id").cast("long").alias("cluster_id"),
        F.lit(",".join(index.columns)).alias("columns"),
        F.posexplode_outer("embedding").alias("i", "v"),
    ).select("doc_id", "cluster_id", "columns", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query
def model_roundtrip(t):
    vectors = t.scan("embeddings")
    model = classifier.train_classifier(vectors)
    kmeans = clustering.train_kmeans(vectors)
    folder = shared_folder(t.spark, "models")
    artifacts.save_models(folder, model, kmeans)
    model2, kmeans2 = artifacts.load_models(folder)
    before = clustering.predict_clusters(kmeans, classifier.class_probabilities(model, vectors))
    after = clustering.predict_clusters(
        kmeans2, classifier.class_probabilities(model2, before.withColumnsRenamed({"ml_probs": "p1", "cluster_id": "c1"}))
    )
    return after.select(
        "vec_id",
        (F.col("p1") == F.col("ml_probs")).cast("long").alias("same_probabilities"),
        (F.col("c1") == F.col("cluster_id")).cast("long").alias("same_cluster"),
    )


@query
def evaluation_report(t):
    results = metrics.outcomes(t.preds())
    vectors = t.read("embeddings")
    quality = clustering.silhouette(vectors.withColumnRenamed("label", "cluster_id"), 10)
    size = vectors.agg(F.count(F.lit(1)).alias("n_resumes"))
    return build_report(results, quality, 10, size).select("section", "name", r6(F.col("value")).alias("value"))


# ---- text ------------------------------------------------------------------------------------


@query
def strip_html(t):
    return t.read("pages").select("page_id", X.strip_html(F.col("html")).alias("out"))


@query
def strip_email(t):
    return text_query(X.strip_email)(t)


@query
def strip_url(t):
    return t.screening_docs().select("doc_id", X.strip_url(F.col("doc_text")).alias("out"))


@query
def strip_phone(t):
    return text_query(X.strip_phone)(t)


@query
def drop_repeated_lines(t):
    return text_query(X.drop_repeated_lines)(t)


@query
def collapse_whitespace(t):
    return t.read("pages").select("page_id", X.collapse_whitespace(F.col("html")).alias("out"))


@query
def clean_text(t):
    return text_query(X.clean_text)(t)


@query
def noise_counts(t):
    return t.screening_docs().select("doc_id", X.noise_counts(F.col("doc_text")).alias("n")).select("doc_id", "n.*")


def _cleaned(t):
    return t.screening_docs().select("doc_id", X.clean_text(F.col("doc_text")).alias("clean_text"))


@query
def section_headers(t):
    kept = _cleaned(t).select("doc_id", F.posexplode_outer(S.section_headers(F.col("clean_text"))).alias("place", "h"))
    return kept.filter(F.col("place").isNotNull()).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.col("h.pos").cast("long").alias("pos"), "h.section"
    )


def _sections(t):
    return _cleaned(t).select("doc_id", S.extract_sections(F.col("clean_text")).alias("s"))


@query
def extract_sections(t):
    return _sections(t).select("doc_id", "s.*")


@query
def embedding_text(t):
    return _sections(t).select("doc_id", S.embedding_text(F.col("s")).alias("out"))


@query
def build_chunks(t):
    return _sections(t).select("doc_id", S.build_chunks(F.col("s")).alias("c")).select("doc_id", "c.*")


@query
def preprocess_corpus(t):
    """The corpus form: every row of the normalised corpus, raw text to chunks."""
    rows = t.read("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("doc_text"))
    return screening.preprocess(rows, "doc_text").select("id", "chunks.*")


@query
def chunk_profile(t):
    chunks = _sections(t).select("doc_id", S.build_chunks(F.col("s")).alias("c"))
    return chunks.select("doc_id", S.chunk_lengths(F.col("c")).alias("n")).select("doc_id", "n.*")


@query
def years_experience(t):
    return t.screening_docs().select("doc_id", X.years_experience(F.col("doc_text")).cast("long").alias("years"))


@query
def reject_blank(t):
    """Jobs and documents together: blank job texts are turned away with a reason."""
    rows = t.jobs().select(F.col("job_id").alias("id"), F.col("jd_text").alias("body")).unionByName(
        t.scan("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    )
    accepted, rejected = corpus.split_blank(rows, "body")
    return accepted.withColumn("reason", F.lit("")).unionByName(rejected)


# ---- skills and domains ----------------------------------------------------------------------


@query
def all_skills(t):
    """Distinct lower-case skills of an ontology taken from the part table."""
    skills = t.scan("part").select(F.upper("p_name").alias("skill"))
    return files.all_skills(skills)


def _skills(t):
    return _cleaned(t).select("doc_id", K.skills_in(F.col("clean_text"), STANDARD).alias("skills"))


@query
def normalize_skills(t):
    """Every comma- or line-separated piece of a text, as written, with its canonical form."""
    raw = F.split(F.expr(DOC_TEXT), "[,\n]")
    return t.read("documents").select("doc_id", F.posexplode_outer(raw).alias("place", "raw")).select(
        "doc_id", F.col("place").cast("long").alias("place"), "raw", K.normalize_skill(F.col("raw"), STANDARD).alias("skill")
    )


@query
def extract_skills(t):
    return _skills(t).select("doc_id", joined(F.col("skills")).alias("skills"))


@query
def extract_skills_joined(t):
    """Skills of a loaded ontology, the part names with one alias; each document names a part."""
    parts = t.scan("part")
    n_parts = t.count("part")
    named = parts.select((F.col("p_partkey") % n_parts).alias("place"), F.lower("p_name").alias("p_name"))
    docs = _cleaned(t).withColumn("place", F.col("doc_id") % n_parts).join(named, "place", "left")
    texts = docs.select("doc_id", F.concat("clean_text", F.lit(" x"), F.coalesce("p_name", F.lit("")), F.lit("y")).alias("clean_text"))
    alias = t.spark.range(1).select(F.lit("the").alias("alias"), F.lit("small ring").alias("canonical"))
    terms = term_table(parts.select(F.col("p_name").alias("skill")), alias)
    return skills_by_automata(texts, terms).select("doc_id", joined(F.col("skills")).alias("skills"))


@query
def skill_frequency(t):
    # Plain explode would make the optimizer test the array first and so compute it twice more.
    found = _skills(t).select(F.explode_outer("skills").alias("skill")).filter(F.col("skill").isNotNull())
    return found.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def _evidence(t):
    return _skills(t).select("doc_id", "skills", K.domain_evidence(F.col("skills"), STANDARD).alias("evidence"))


@query
def domain_overlap(t):
    return _evidence(t).select("doc_id", F.explode_outer("evidence").alias("e")).select(
        "doc_id",
        F.col("e.domain").alias("domain"),
        F.col("e.n_overlap").cast("long").alias("n_overlap"),
        joined(F.col("e.matched")).alias("matched"),
    )


@query
def domain_scores(t):
    return _evidence(t).select("doc_id", F.explode_outer("evidence").alias("e")).select(
        "doc_id", F.col("e.domain").alias("domain"), r6(F.col("e.score")).alias("score")
    )


@query
def top_domains(t):
    best = _evidence(t).select("doc_id", F.posexplode_outer(K.top_domains(F.col("evidence"), 3)).alias("at", "d"))
    return best.select(
        "doc_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("d.domain").alias("domain"), r6(F.col("d.score")).alias("score")
    )


# ---- embedding jobs --------------------------------------------------------------------------


@query
def content_fingerprint(t):
    return t.read("documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query
def embed_incremental(t):
    """English documents were encoded earlier; the whole table then arrives."""
    store = EmbeddingStore(t.spark, shared_folder(t.spark, "vectors"), HashingEncoder())
    docs = t.read("documents").select("doc_id", "lang", "text")
    store.add(docs.filter(F.col("lang") == "en"), "text")
    store.compact()
    pending = store.missing(docs, "text").withColumnRenamed("text_key", "pending")
    # Which texts were pending has to be settled before the store grows.
    folder = shared_folder(t.spark, "pending")
    pending.write.parquet(folder)
    store.add(docs, "text")
    encoded = t.spark.read.parquet(folder)
    whole = store.attach(docs.select("doc_id", "text"), "text")
    encoded = encoded.select(F.col("pending").alias("text_key"), F.lit(1).cast("long").alias("was_pending"))
    marked = skew_join(whole, encoded, "text_key", "left", "doc_id")
    return marked.select(
        "doc_id", F.coalesce("was_pending", F.lit(0).cast("long")).alias("was_pending"), F.posexplode_outer("embedding").alias("i", "v")
    ).select("doc_id", "was_pending", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


def _plain_model():
    """A local text model: length, blanks and letters e of a text."""
    return lambda texts: [[float(len(x)), float(x.count(" ")), float(x.count("e"))] for x in texts]


@query
def encode_plugin(t):
    """Document vectors by a plugged-in model over the non-empty chunks."""
    chunks = _sections(t).select("doc_id", S.build_chunks(F.col("s")).alias("chunks"))
    vectors = embed_chunks(chunks, ModelEncoder("plain", _plain_model, normalize=False))
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("i", "v"))
    return long.select("doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query
def encode_text(t):
    vectors = HashingEncoder().encode(t.read("documents").select("doc_id", "text"), "text")
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("i", "v"))
    return long.select("doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query
def pool_chunks_query(t):
    pooled = pool_chunks(t.chunk_vecs())
    long = pooled.select("doc_id", F.posexplode_outer("embedding").alias("i", "v"))
    return long.select("doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


QUERIES["pool_chunks"] = QUERIES.pop("pool_chunks_query")


@query
def l2_normalize(t):
    """Documents as raw token counts, scaled to unit length."""
    counts = HashingEncoder(normalize=False).encode(t.read("documents").select("doc_id", "text"), "text")
    long = counts.select("doc_id", F.posexplode_outer(V.l2_normalize(F.col("embedding"))).alias("i", "v"))
    return long.select("doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


# ---- similarity and matching -----------------------------------------------------------------


def _pairs(t):
    """The requested pairs with both vectors and both skill lists."""
    docs = t.doc_vectors().join(_skills(t), "doc_id")
    jobs = screening.prepare_jobs(t.job_vectors()).select("job_id", "jd_skills", "jd_embedding")
    return _requested(t, docs, jobs)


def _requested(t, docs, jobs):
    """Requests with both sides; a third of them want the same job."""
    hot = hot_tables(t.requests(), ["doc_id", "job_id"])
    with_docs = skew_join(t.requests(), docs, "doc_id", "inner", "job_id", hot=hot["doc_id"])
    return skew_join(with_docs, jobs, "job_id", "inner", "doc_id", hot=hot["job_id"])


@query
def pair_cosine(t):
    vectors = _requested(t, t.doc_vectors(), t.job_vectors().select("job_id", "jd_embedding"))
    return vectors.select("doc_id", "job_id", r6(V.cosine(F.col("embedding"), F.col("jd_embedding"))).alias("similarity"))


def _ranked(ranked, query_key, doc_key):
    return ranked.select(query_key, "rank", doc_key, r6(F.col("similarity")).alias("similarity"))


@query
def topn_similar(t):
    """Class mean vectors against all vectors."""
    means = clustering.centroids_by(t.scan("embeddings"), "label").select("label", F.col("centroid").alias("embedding"))
    return _ranked(rank_by_cosine(means, t.read("embeddings"), 5, "label", "vec_id"), "label", "vec_id")


@query
def jd_ranked_docs(t):
    jobs = t.job_vectors().select("job_id", F.col("jd_embedding").alias("embedding"))
    return _ranked(rank_by_cosine(jobs, t.doc_vectors(), 5, "job_id", "doc_id"), "job_id", "doc_id")


@query
def ranked_from_store(t):
    """The same lists from an index that has been written and loaded again."""
    folder = shared_folder(t.spark, "cells")
    cut_into_cells(t.doc_vectors(), folder=folder)
    jobs = t.job_vectors().select("job_id", F.col("jd_embedding").alias("embedding"))
    return _ranked(rank_by_cosine(jobs, load_cells(t.spark, folder), 5, "job_id", "doc_id"), "job_id", "doc_id")


@query
def similar_docs(t):
    corpus_rows = t.read("embeddings").select("vec_id", "embedding")
    queries = corpus_rows.withColumnRenamed("vec_id", "query_id")
    return _ranked(rank_by_cosine(queries, corpus_rows, 5, "query_id", "vec_id"), "query_id", "vec_id")


@query
def matched_skills(t):
    return match_columns(_pairs(t)).select("doc_id", "job_id", joined(F.col("matched_skills")).alias("matched"))


@query
def missing_skills(t):
    return match_columns(_pairs(t)).select("doc_id", "job_id", joined(F.col("missing_skills")).alias("missing"))


@query
def match_pairs(t):
    return match_columns(_pairs(t)).select(
        "doc_id",
        "job_id",
        r6(F.col("similarity")).alias("similarity"),
        joined(F.col("matched_skills")).alias("matched"),
        joined(F.col("missing_skills")).alias("missing"),
        "explanation",
    )


# ---- models ----------------------------------------------------------------------------------


@query
def label_encode(t):
    docs = t.read("documents").select("doc_id", F.col("source").alias("label"))
    return classifier.label_index(docs).select("doc_id", "label", "label_id")


def _split(t):
    return classifier.stratified_split(t.scan("embeddings"), "label", "vec_id")


@query
def stratified_split(t):
    return _split(t).select("vec_id", "label", "split")


@query
def split_counts(t):
    return classifier.split_counts(_split(t)).select("n_train", "n_test", joined(F.col("classes"), ",").alias("classes"))


@query
def class_weights(t):
    return classifier.class_weights(t.scan("embeddings")).select("label", "n", r6(F.col("weight")).alias("weight"))


def _fitted(t):
    split = _split(t)
    return split, classifier.train_classifier(split.filter(F.col("split") == "train").drop("split"))


@query
def train_classifier(t):
    """What the fit has to satisfy: rows and weight of each class, and a vanishing gradient.

    The gradient of the class-balanced, penalised loss is taken over the training rows at the
    fitted coefficients; its bound is five hundredths of the root of the number of rows.
    """
    split, model = _fitted(t)
    train = split.filter(F.col("split") == "train")
    weights = classifier.class_weights(train).select(F.col("label").cast("string").alias("class"), "n", "weight")
    scored = classifier.class_probabilities(model, train)
    own = weights.select(F.col("class").alias("_own"), F.col("weight").alias("_w"))
    rows = scored.join(own, F.col("label").cast("string") == F.col("_own")).select(
        "_own", "_w", "embedding", F.explode("ml_probs").alias("r")
    )
    error = F.col("_w") * (F.col("r.p") - F.when(F.col("r.class") == F.col("_own"), 1.0).otherwise(0.0))
    gaps = rows.select(F.col("r.class").alias("class"), array_to_vector(F.transform("embedding", lambda x: x * error)).alias("g"))
    sums = gaps.groupBy("class").agg(vector_to_array(Summarizer.sum(F.col("g"))).alias("g"))
    coefficients = model.stages[-1].coefficientMatrix.toArray().tolist()
    penalty = F.element_at(
        F.create_map(*[F.lit(x) for c, w in zip(classifier.model_classes(model), coefficients) for x in (c, w)]), F.col("class")
    )
    steepest = F.array_max(F.transform(F.zip_with("g", penalty, lambda a, b: a + b), F.abs))
    bound = 0.05 * F.sqrt(weights.agg(F.sum("n")).scalar())
    return sums.join(weights, "class").select(
        "class", "n", r6(F.col("weight")).alias("weight"), (steepest < bound).cast("long").alias("is_optimal")
    )


@query
def class_probabilities(t):
    """Per row: the classes, and whether their probabilities descend, add up to one and lie between 0 and 1."""
    split, model = _fitted(t)
    p = F.transform("ml_probs", lambda r: r["p"])
    scored = classifier.class_probabilities(model, split).withColumn("p", p)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        "vec_id",
        "split",
        F.array_join(F.array_sort(F.transform("ml_probs", lambda r: r["class"])), ",").alias("classes"),
        (F.col("p") == F.reverse(F.array_sort("p"))).cast("long").alias("descends"),
        (F.abs(total - 1.0) < 1e-9).cast("long").alias("adds_up"),
        F.forall("p", lambda x: (x >= 0) & (x <= 1)).cast("long").alias("is_share"),
    )


def _ranked_wide(t, table=None):
    return t.wide_preds(table).withColumn("ml_probs", classifier.ranked_probabilities(CLASS_NAMES, F.col("probs")))


@query
def top3_classes(t):
    top = _ranked_wide(t).select(
        "vec_id",
        r6(classifier.max_probability(F.col("ml_probs"))).alias("max_p"),
        F.posexplode_outer(classifier.top_classes(F.col("ml_probs"))).alias("at", "c"),
    )
    return top.select(
        "vec_id",
        "max_p",
        (F.col("at") + 1).cast("long").alias("rank"),
        F.col("c.domain").alias("domain"),
        r6(F.col("c.pct")).alias("pct"),
    )


@query
def train_kmeans(t):
    """Per row: whether its cluster is one of ten and has the nearest of the fitted centres."""
    vectors = t.scan("embeddings")
    model = clustering.train_kmeans(vectors)
    centers = F.array(*[F.lit(c.tolist()) for c in model.clusterCenters()])
    gap = lambda c: F.aggregate(F.zip_with("embedding", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    gaps = clustering.predict_clusters(model, vectors).withColumn("gaps", F.transform(centers, gap))
    own = F.get("gaps", F.col("cluster_id"))
    return gaps.select(
        "vec_id",
        F.size("gaps").cast("long").alias("clusters"),
        (own <= F.array_min("gaps") + 1e-9).cast("long").alias("is_nearest"),
    )


@query
def assign_clusters(t):
    labels, centers = t.label_centroids
    return clustering.assign_clusters(t.read("embeddings"), labels, centers).select("vec_id", "cluster_id")


@query
def cluster_profile(t):
    labels, centers = t.label_centroids
    assigned = clustering.assign_clusters(t.read("embeddings"), labels, centers)
    profile = clustering.cluster_profile(assigned, "cluster_id")
    long = profile.select("cluster_id", "n", F.posexplode_outer("centroid").alias("i", "v"))
    return long.select("cluster_id", "n", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query
def silhouette(t):
    clustered = t.read("embeddings").withColumnRenamed("label", "cluster_id")
    return clustering.silhouette(clustered, 10).select(r6(F.col("silhouette")).alias("silhouette"), "n")


# ---- metrics ---------------------------------------------------------------------------------


def _outcomes(t):
    return metrics.outcomes(t.preds())


def rounded(df, *keep):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


@query
def accuracy(t):
    return rounded(metrics.accuracy(_outcomes(t)))


@query
def confusion_counts(t):
    return metrics.confusion_counts(_outcomes(t)).select(
        F.col("y_true").cast("long").alias("y_true"), F.col("y_pred").cast("long").alias("y_pred"), "n"
    )


@query
def macro_prf(t):
    return rounded(metrics.macro_prf(metrics.confusion_counts(_outcomes(t))))


def _class_report(t):
    return metrics.class_report(metrics.confusion_counts(_outcomes(t)))


@query
def class_report(t):
    return rounded(_class_report(t), "class", "support").withColumn("class", F.col("class").cast("long"))


@query
def report_averages(t):
    return rounded(metrics.report_averages(_class_report(t)), "average", "support")


@query
def topk_accuracy(t):
    return rounded(metrics.top_k_accuracy(_outcomes(t), 3))


@query
def mrr(t):
    return rounded(metrics.mean_reciprocal_rank(_outcomes(t)))


@query
def metrics_summary(t):
    return rounded(metrics.metrics_summary(_outcomes(t)))


# ---- decisions and scores --------------------------------------------------------------------


def _doc_inputs(t):
    """Prepared documents with their vector and ranked class probabilities."""
    return _ranked_wide(t, screening.prepare_documents(t.screening_docs()).join(t.doc_vectors(), "doc_id"))


def _decided(t):
    """Documents with text, decided."""
    docs = screening.prepare_documents(screening.accepted(t.screening_docs()))
    return screening.decide_documents(_ranked_wide(t, docs.join(t.doc_vectors(), "doc_id")))


def listed(c):
    """Secondary domains as text, probabilities on six digits."""
    return joined(
        F.transform(c, lambda s: F.concat(s["domain"], F.lit("="), (F.floor(s["p"] * 1000000 + 0.5)).cast("string")))
    )


def _outer_inputs(t):
    """All prepared documents and jobs' texts; job texts have no probabilities."""
    docs = _doc_inputs(t).select("doc_id", "ml_probs", "evidence", "clean_text")
    texts = t.jobs().select((-F.col("job_id") - 1).alias("doc_id"), F.col("jd_text").alias("doc_text"))
    bare = screening.prepare_documents(texts).select("doc_id", "evidence", "clean_text")
    return docs.unionByName(bare, allowMissingColumns=True)


@query
def multi_domain(t):
    return decide(_doc_inputs(t)).select(
        "doc_id", F.col("is_multi_domain").cast("long").alias("is_multi"), listed(F.col("secondary_domains")).alias("secondary")
    )


@query
def evidence_override(t):
    return decide(_doc_inputs(t)).select(
        "doc_id", F.col("is_overridden").cast("long").alias("overridden"), "primary_domain"
    )


@query
def decision_trace(t):
    return decide(_outer_inputs(t)).select("doc_id", joined(F.col("trace"), " ").alias("trace"))


@query
def decide_query(t):
    return decide(_outer_inputs(t)).select(
        "doc_id",
        "primary_domain",
        listed(F.col("secondary_domains")).alias("secondary"),
        r6(F.col("confidence")).alias("confidence"),
        F.col("years").cast("long").alias("years"),
    )


QUERIES["decide"] = QUERIES.pop("decide_query")


def _job_side(t):
    return screening.prepare_jobs(t.job_vectors())


def _screened(t):
    return screening.screen(_decided(t), _job_side(t), t.requests())


def flat_scores(scored, *more):
    return scored.select(
        "doc_id",
        "job_id",
        r6(F.col("suitability")).alias("suitability"),
        "match_strength",
        r6(F.col("similarity")).alias("similarity"),
        "alpha",
        r6(F.col("max_p")).alias("max_p"),
        joined(F.transform(F.col("top_domains"), lambda d: d["domain"])).alias("top_domains"),
        "primary_domain",
        listed(F.col("secondary_domains")).alias("secondary"),
        r6(F.col("confidence")).alias("confidence"),
        joined(F.col("trace"), " ").alias("trace"),
        joined(F.col("skills")).alias("skills"),
        joined(F.col("matched_skills")).alias("matched"),
        joined(F.col("missing_skills")).alias("missing"),
        "explanation",
        F.col("chunk_lengths.summary_len").alias("summary_len"),
        F.col("chunk_lengths.experience_len").alias("experience_len"),
        F.col("chunk_lengths.skills_len").alias("skills_len"),
        "reason",
        *more,
    )


def _ids(c):
    return joined(F.transform(F.col(c), lambda e: e["ranked_id"].cast("string"))).alias(c)



@query
def suitability(t):
    return _screened(t).select(
        "doc_id", "job_id", r6(F.col("similarity_component")).alias("component"), "alpha", r6(F.col("suitability")).alias("suitability")
    )


@query
def match_strength(t):
    return _screened(t).select("doc_id", "job_id", "match_strength")


@query
def screen_pairs(t):
    """The full report of every requested pair, with cluster and both ranked lists."""
    labels, centers = t.label_centroids
    docs = clustering.assign_clusters(_decided(t), labels, centers)
    index = t.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs, jobs = screening.with_rankings(docs, _job_side(t), index)
    scored = screening.screen(docs, jobs, t.requests())
    return flat_scores(scored, "cluster_id", _ids("jd_ranked_docs"), _ids("similar_docs"))


@query
def shortlist_query(t):
    best = shortlist(_screened(t), 5)
    return best.select("job_id", "rank", "doc_id", r6(F.col("suitability")).alias("suitability"), "match_strength")


QUERIES["shortlist"] = QUERIES.pop("shortlist_query")


# ---- streaming -------------------------------------------------------------------------------


@query
def stream_screen(t):
    """The documents table, one file or a folder of them, as a stream of arrivals; the same rows and columns as the batch run."""
    schema = t.scan("documents").schema.simpleString()[7:-1].replace(":", " ")
    # A stream takes a plain path as a folder; a pattern may also match a single file.
    arrivals = stream.read_documents(t.spark, f"{t.folder}/documents.parque[t]", schema).select(
        "doc_id", F.expr(DOC_TEXT).alias("doc_text"), t.wanted_jobs().alias("job_ids")
    )
    labels, centers = t.label_centroids
    index = cut_into_cells(t.scan("embeddings"), "vec_id")

    def settled(df, name):
        """What no batch changes is computed once."""
        folder = shared_folder(t.spark, name)
        df.write.parquet(folder)
        return t.spark.read.schema(df.schema).parquet(folder)

    static = settled(_ranked_wide(t, t.doc_vectors()).select("doc_id", "embedding", "ml_probs"), "stream-docs")
    jobs = settled(screening.rank_for_jobs(_job_side(t), index), "stream-jobs")

    def add_lists(docs):
        return screening.rank_documents(clustering.assign_clusters(docs, labels, centers), index)

    def score(batch):
        scored = stream.screen_arrivals(batch, jobs, lambda df: df.join(static, "doc_id"), add_lists=add_lists)
        return flat_scores(scored, "cluster_id", _ids("jd_ranked_docs"), _ids("similar_docs"))

    output, state = shared_folder(t.spark, "stream-out"), shared_folder(t.spark, "stream-state")
    stream.run(arrivals, score, output, state, t.spark.sparkContext.defaultParallelism).awaitTermination()
    return t.spark.read.parquet(output).drop("batch_id")
