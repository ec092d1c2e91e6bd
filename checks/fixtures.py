"""Tables derived from the given ones. Fragments of plain SQL are shared by both engines."""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.binding import let
from sieveline.operators.blocks import matrix
from sieveline.operators.clustering import centroids_by, collect_centroids
from sieveline.sources.files import read_table

NL = "chr(10)"
SKILL_LINE = """concat_ws(', ', case when doc_id % 2 = 0 then 'python' end, case when doc_id % 3 = 0 then 'sql' end,
  case when doc_id % 5 = 0 then 'docker' end, case when doc_id % 7 = 0 then 'React Native' end,
  case when doc_id % 11 = 0 then 'scikit learn' end, case when doc_id % 13 = 0 then 'HTML' end)"""

# Headings, skills, years and noise around the whole text of every document.
# One document in 97 is blank.
DOC_TEXT = f"""case when doc_id % 97 = 5 then concat(' ', {NL}) else case doc_id % 4
  when 0 then text
  when 1 then concat('Summary', {NL}, substr(text, 1, 200), {NL}, 'Skills:', {NL}, {SKILL_LINE}, {NL},
    'Work Experience', {NL}, cast(doc_id % 13 as varchar(10)), '+ years ', substr(text, 201))
  when 2 then concat('Technical Skills', {NL}, {SKILL_LINE}, {NL}, 'Page', {NL}, 'Profile', {NL}, text)
  else concat('<b>Resume</b>', {NL}, 'a.b@mail.example.com www.example.com/x +1 (415) 555-2671', {NL},
    {SKILL_LINE}, {NL}, text) end end"""

# One job in ten is blank and has no vector.
JOB_TEXT = f"""case when item_id % 10 = 9 then '' else concat('Skills:', {NL}, concat_ws(', ',
    case when item_id % 2 = 0 then 'python' end, case when item_id % 3 = 0 then 'rest api' end,
    case when item_id % 4 = 0 then 'kubernetes' end, 'sql'), {NL}, 'Experience', {NL},
    cast(item_id % 9 as varchar(10)), ' years ', text) end"""
JOB_VECTOR = "case when item_id % 10 = 9 then cast(-1 as bigint) else item_id end"

# Every document asks for two jobs; a third of all documents ask for job 0. The placeholders
# stand for the numbers of jobs and of vectors.
FIRST_JOB = "doc_id % {n_jobs}"
SECOND_JOB = "case when doc_id % 3 = 0 then cast(0 as bigint) else (doc_id * 7 + 1) % {n_jobs} end"
DOC_VECTOR = "doc_id % {n_vecs}"

# One vector is one chunk; every seventh carries a chunk name that has no weight.
CHUNK_DOC = "cast(floor(vec_id / 3) as bigint)"
CHUNK_NAME = """case when vec_id % 7 = 0 then 'other' when vec_id % 3 = 0 then 'summary'
  when vec_id % 3 = 1 then 'experience' else 'skills' end"""

CLASS_NAMES = [
    "Data Science", "Web Development", "DevOps", "Mobile Development", "Cybersecurity",
    "Other 5", "Other 6", "Other 7", "Other 8", "Other 9",
]


class Tables:
    """The tables of one data folder, given and derived."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        """The table, dealt to the number of partitions that the session asks for, if it does.

        The given small tables are single row groups, which a scan cannot split.
        """
        asked = self.spark.conf.get("sieveline.scan.partitions", None)
        return read_table(self.spark, f"{self.folder}/{name}.parquet", int(asked) if asked else None)

    def scan(self, name: str) -> DataFrame:
        """Without the spreading step: for work that is shuffled or cheap anyway."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def count(self, name: str) -> int:
        """Row count; Parquet answers it from the file footers."""
        return self.scan(name).count()

    def screening_docs(self) -> DataFrame:
        return self.read("documents").select("doc_id", F.expr(DOC_TEXT).alias("doc_text"))

    def jobs(self) -> DataFrame:
        return self.scan("benchmark").select(
            F.col("item_id").alias("job_id"),
            F.expr(JOB_TEXT).alias("jd_text"),
            F.expr(JOB_VECTOR).alias("vec_id"),
        )

    def job_vectors(self) -> DataFrame:
        vectors = self.scan("embeddings").select("vec_id", F.col("embedding").alias("jd_embedding"))
        return self.jobs().join(vectors, "vec_id", "left")

    def doc_vector(self) -> Column:
        return F.expr(DOC_VECTOR.format(n_vecs=self.count("embeddings")))

    def wanted_jobs(self) -> Column:
        n_jobs = self.count("benchmark")
        return F.array_distinct(F.array(*[F.expr(e.format(n_jobs=n_jobs)) for e in (FIRST_JOB, SECOND_JOB)]))

    def doc_vectors(self) -> DataFrame:
        """``doc_id, embedding``: documents share the vectors in turn."""
        vectors = self.scan("embeddings").select("vec_id", "embedding")
        docs = self.scan("documents").select("doc_id", self.doc_vector().alias("vec_id"))
        return docs.join(vectors, "vec_id").select("doc_id", "embedding")

    def requests(self) -> DataFrame:
        return self.scan("documents").select("doc_id", F.explode(self.wanted_jobs()).alias("job_id"))

    def chunk_vecs(self) -> DataFrame:
        return self.read("embeddings").select(
            F.expr(CHUNK_DOC).alias("doc_id"), F.expr(CHUNK_NAME).alias("chunk"), "embedding"
        )

    @cached_property
    def label_centroids(self):
        """Class labels and their mean vectors."""
        return collect_centroids(centroids_by(self.scan("embeddings"), "label"), "label")

    def wide_preds(self, table: DataFrame | None = None) -> DataFrame:
        """Adds ``probs``: softmax of ten times the dot product with the mean vector of each class."""
        _, centers = self.label_centroids

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scores(v):
            import pyarrow as pa

            return pa.array(list(matrix(v) @ centers.T), type=pa.list_(pa.float64()))

        raised = F.transform(scores(F.col("embedding")), lambda d: F.exp(d * 10.0))
        table = self.read("embeddings") if table is None else table
        return table.withColumn(
            "probs",
            let(
                raised,
                lambda e: let(
                    F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                    lambda total: F.transform(e, lambda x: x / total),
                ),
            ),
        )

    def preds(self) -> DataFrame:
        """``doc_id, y_true, class, p`` in long form."""
        return self.wide_preds().select(
            F.col("vec_id").alias("doc_id"), F.col("label").alias("y_true"), F.posexplode_outer("probs").alias("class", "p")
        )
