"""Small helpers shared by the operators of this subpackage."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import shared_folder

#: Bytes of text that a task turns into arrays at once.
BLOCK_BYTES = 4 * 1024 * 1024


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, lineage cut."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of whole rows with their texts, each of about ``size`` bytes or one longer row."""
    texts = utf8(batch.column(text))
    start = held = 0
    for i, value in enumerate(texts):
        if held and held + len(value) > size:
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(value)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """The schema with more columns; the given one stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more.items())])


class Forest:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b
