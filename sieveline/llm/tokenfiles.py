"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Rows are range-partitioned and sorted by doc_id; each partition writes files of its own:

- ``NAME.tokens``: the ids of all documents, one after the other, each document closed by the end
  id; little-endian unsigned integers of 2 bytes if the vocabulary fits, else 4;
- ``NAME.offsets``: n + 1 little-endian unsigned 64-bit numbers, the ids before each document;
- ``NAME.ids``: n little-endian signed 64-bit doc_ids (the least number stands for null).

Files get their final names by a rename once they are complete, and only those in the manifest
count. A file's base, the ids in all files before it, is the prefix sum over the manifest (one row
per file); base plus offset is a document's place in the whole. A task that runs twice writes the
same bytes to the same name. Readers map the files into memory.

A text is cut at ASCII white space, which this tokenizer drops and across which nothing merges, and
each distinct piece goes through the tokenizers library once per worker while it is remembered; the
number of remembered pieces is bounded, and the frequent ones stay. Pieces of Latin letters, with or
without ASCII marks behind them, go to the library's model directly, lower-cased and as letters for
bytes: its normalizer and splitter do no more to them but cut before the marks. The model sees a
lower-cased word and a run of marks once while they are remembered, in whatever pieces they stand.
Equal ids stand in the order of a hash of their texts. Null and empty texts are the end id alone;
other columns are ignored. doc_id must be an integer.
"""

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, cut, id_and_text
from sieveline.session import shared_folder

FILE_BYTES = 256 * 1024 * 1024
#: Distinct pieces, and lower-cased words, that a worker remembers (about 200 bytes each), and the longest such one.
REMEMBERED, WORDS, LONGEST = 1_200_000, 300_000, 200
NULL_ID = -(1 << 63)
#: Latin letters (U+0041 to U+00FF, bytes of UTF-8), and ASCII marks before which the tokenizer cuts: all but the apostrophe.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)").fullmatch

#: The model's letter for a byte: printable Latin-1 stands for itself, other bytes for U+0100 and on, in order.
_OTHER = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(_OTHER)}


class Encoder(dict):
    """Texts to the bytes of their ids, by way of remembered pieces: a mapping from a piece to its ids.

    Pieces are remembered in two generations. When the younger is full it becomes the older and what
    was the older is forgotten, so frequent pieces stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.older: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.packed = {i: self.pack([i]) for i in self.tokenizer.get_vocab().values()}
        self.words: dict[bytes, bytes] = {}

    def by_model(self, plain: bytes) -> bytes:
        """Ids of a lower-cased word or of a run of marks."""
        found = self.words.get(plain)
        if found is None:
            text = plain.decode() if plain.isascii() else plain.decode("latin-1").translate(BYTE_LETTERS)
            found = b"".join([self.packed[t.id] for t in self.model.tokenize(text)])
            if len(plain) <= LONGEST:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[plain] = found
        return found

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            if piece.isalpha():  # ASCII letters alone, as most are
                found = self.by_model(piece.lower())
            elif (plain := PLAIN(piece)) is None:
                found = self.pack(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)
            else:
                word, marks = plain.groups()
                found = self.by_model(word.lower() if word.isascii() else word.decode().lower().encode())
                if marks:
                    found += self.by_model(marks)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _File:
    """The three files of one name, written under temporary names."""

    def __init__(self, store: pafs.FileSystem, folder: str, name: str, attempt: int):
        self.store, self.final, self.temporary = store, f"{folder}/{name}", f"{folder}/.{name}.{attempt}"
        self.tokens = store.open_output_stream(f"{self.temporary}.tokens")
        self.offsets, self.ids = [0], []

    def add(self, doc_id: int | None, data: bytes, width: int) -> None:
        self.tokens.write(data)
        self.offsets.append(self.offsets[-1] + len(data) // width)
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def commit(self) -> None:
        self.tokens.close()
        for kind, values, form in (("offsets", self.offsets, "<u8"), ("ids", self.ids, "<i8")):
            with self.store.open_output_stream(f"{self.temporary}.{kind}") as out:
                out.write(np.array(values, form).tobytes())
        for kind in ("tokens", "offsets", "ids"):
            self.store.move(f"{self.temporary}.{kind}", f"{self.final}.{kind}")


MANIFEST = "name string, width int, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = FILE_BYTES, partitions: int | None = None,
) -> DataFrame:
    """Writes the files and returns the manifest: name, width, n_docs, n_tokens, base of each file."""
    spark = docs.sparkSession
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        done, current = [], None

        def commit():
            current.commit()
            done.append((current.final.rsplit("/", 1)[1], enc.width, len(current.ids), current.offsets[-1]))

        for batch in batches:
            for part, texts in blocks(batch):
                for doc_id, data in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    if current and current.offsets[-1] * enc.width >= file_bytes:
                        commit()
                        current = None
                    if current is None:
                        current = _File(store, path, f"{task.partitionId():06d}-{len(done):06d}", task.taskAttemptId())
                    current.add(doc_id, data + end, enc.width)
        if current:
            commit()
        columns = list(zip(*done)) or [(), (), (), ()]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["name", "width", "n_docs", "n_tokens"]
        )

    written = cut(rows.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)

        def mapped(name):
            return pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)

        for batch in batches:
            for row in batch.to_pylist():
                name, width = f"{path}/{row['name']}", row["width"]
                with mapped(f"{name}.offsets") as file:
                    offsets = np.frombuffer(file.read(), "<u8").astype(np.int64)
                with mapped(f"{name}.ids") as file:
                    ids = np.frombuffer(file.read(), "<i8")
                with mapped(f"{name}.tokens") as file:
                    at = 0
                    while at < len(ids):
                        # Whole documents of about 4 MB together.
                        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20))) - 1)
                        stop = min(stop, len(ids))
                        file.seek(int(offsets[at]) * width)
                        raw = file.read((int(offsets[stop]) - int(offsets[at])) * width)
                        data = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        ends = (offsets[at : stop + 1] - offsets[at]) * 4
                        held = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                        columns = [
                            pa.array([None if x == NULL_ID else x for x in ids[at:stop].tolist()], pa.int64()),
                            pa.array(offsets[at:stop] + row["base"]),
                            pa.array(np.diff(offsets[at : stop + 1])),
                            pa.array(held, pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                        at = stop

    dealt = manifest.select("name", "width", "base").repartition(files)
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from files written in the shared folder."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer, id_col=id_col, text_col=text_col)
    read = read_token_files(spark, manifest, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
