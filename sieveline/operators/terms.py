"""Skills found by automata, for an ontology that is a table of any size."""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import shared_folder

# Characters of terms in one automaton, which is what a task holds beside its batch of texts.
BLOCK_CHARS = 2_000_000
# Rows that leave a task in one Arrow batch, however many came in with one.
ROWS_OUT = 256


def term_table(domain_skill: DataFrame, alias: DataFrame) -> DataFrame:
    """``needle, skill``: every skill name and alias in lower case, with the skill it stands for."""
    names = domain_skill.where("skill is not null").select(F.lower("skill").alias("needle")).distinct()
    links = alias.select(F.lower(F.trim("alias")).alias("_alias"), F.lower(F.trim("canonical")).alias("_skill")).distinct()
    needles = names.unionByName(links.select(F.col("_skill").alias("needle"))).distinct()
    skills = needles.join(links, needles["needle"] == links["_alias"], "left").select("needle", F.coalesce("_skill", "needle").alias("skill"))
    direct = names.select("needle").join(skills, "needle")
    through = links.join(skills, links["_skill"] == skills["needle"]).select(F.col("_alias").alias("needle"), "skill")
    return direct.unionByName(through).where("needle <> ''").distinct()


def term_blocks(terms: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The terms in pieces of at most ``size`` characters, or one longer term; one piece is held at a time."""
    block, held = [], 0
    for needle, skill in terms.select("needle", "skill").toLocalIterator():
        if block and held + len(needle) + len(skill) > size:
            yield block
            block, held = [], 0
        block.append((needle, skill))
        held += len(needle) + len(skill)
    if block:
        yield block


def automaton(block: list[tuple[str, str]]) -> "ahocorasick.Automaton":
    """Finds every term of a block in one pass over a text; a term may stand for several skills."""
    found = ahocorasick.Automaton()
    for needle, skill in block:
        found.add_word(needle, (*found.get(needle, ()), skill))
    found.make_automaton()
    return found


def skills_by_automata(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "clean_text", size: int = BLOCK_CHARS) -> DataFrame:
    """``key, skills``: the sorted skills of every row whose terms occur anywhere in the text.

    One pass over the texts for each block of terms, without a shuffle: a row carries what it has
    found to the next block. Between two blocks the rows are written, so a job holds one block,
    whatever the number of terms (the driver also holds the next); after the last block nothing is
    written and texts do not come back from the task. Rows are told apart by
    their place only, so null and repeated keys keep their own skills. Null text holds no term.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.array().cast("array<string>").alias("_found")
    )
    schema, held, blocks = rows.schema, None, term_blocks(terms, size)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        if held is not None:
            folder = shared_folder(spark, "skills")
            rows.write.parquet(folder)
            rows = spark.read.schema(schema).parquet(folder)
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        # After the last block no pass needs the texts, so they stay behind.
        carried = schema.fieldNames() if following is not None else ["_key", "_found"]
        rows = rows.mapInArrow(_scan(held, carried), T.StructType([schema[c] for c in carried]))
        block = following
    return rows.select(F.col("_key").alias(key), F.sort_array("_found").alias("skills"))


def _scan(held, carried: list[str]):
    """A pass over Arrow batches that adds the skills of one block to ``_found`` and gives the ``carried`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                found = []
                # One text at a time as a Python object, however many a batch holds.
                for text, before in zip(batch.column("_text"), batch.column("_found")):
                    hits = {skill for _, skills in search.iter(text.as_py()) for skill in skills}
                    found.append(sorted(hits.union(before.as_py())))
                columns = {"_key": batch.column("_key"), "_text": batch.column("_text"), "_found": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in carried})

    return run
