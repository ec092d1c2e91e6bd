"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over whole texts.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window
is ``n`` consecutive words of an item; an item with fewer words is one window. A task numbers the
words of its texts by the vocabulary of the windows (other words get none), hashes every window of
numbers, looks the hashes up in the sorted set, and verifies each hit number by number.

The set is broadcast in blocks of at most ``block_words`` item words (one longer item is a block of its
own). Rows go through the blocks one after the other and carry their hits along; between two blocks
they are written and the block is given back, so a plan holds one block however large the benchmark is.
A benchmark of n blocks costs n - 1 rewrites of the rows that are left.

Null and empty texts and items have no words and no hits. Item ids may repeat: rows with one id
are one item. Rows with a null item_id take part as the item ``null``. Equal documents are scanned
each for itself, and extra columns are ignored.
"""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import blocks, cut, extended, id_and_text

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Item words in one broadcast block (with ten-word windows about 100 bytes each).
BLOCK_WORDS = 2_000_000
#: What a scan finds in a row.
FOUND = {"n_words": T.LongType(), "starts": T.ArrayType(T.LongType()), "stops": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """The windows of some items, by length, as sorted hashes with the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            words = WORD.findall(text.lower())
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            width = min(n, len(numbers))
            for i in range(len(numbers) - width + 1 if width else 0):
                owners.setdefault(tuple(numbers[i : i + width]), set()).add(place[name])
        self.by_length = {}
        for width in sorted({len(w) for w in owners}):
            windows = np.array([w for w in owners if len(w) == width], np.int64)
            hashes = self.hashes(windows.ravel(), width)[::width] if width > 1 else self.hashes(windows.ravel(), 1)
            order = np.argsort(hashes, kind="stable")
            held = [sorted(owners[tuple(w)]) for w in windows[order].tolist()]
            self.by_length[width] = (hashes[order], windows[order], held)

    @staticmethod
    def hashes(numbers: np.ndarray, width: int) -> np.ndarray:
        """A hash of every ``width`` consecutive numbers."""
        values = numbers.astype(np.uint64)
        out = np.zeros(max(0, values.size - width + 1), np.uint64)
        for k in range(width):
            out = out * _BASE + values[k : k + out.size]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, numbers: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(start, length, items) of the windows that occur in a sequence of word numbers."""
        known = np.r_[0, np.cumsum(numbers > 0)]
        for width, (hashes, windows, held) in self.by_length.items():
            starts = np.flatnonzero(known[width:] - known[:-width] == width) if numbers.size >= width else known[:0]
            if not starts.size:
                continue
            seen = self.hashes(numbers, width)[starts]
            at = np.searchsorted(hashes, seen)
            hit = np.flatnonzero(hashes[np.minimum(at, hashes.size - 1)] == seen)
            for i in hit.tolist():
                start, k = int(starts[i]), int(at[i])
                while k < hashes.size and hashes[k] == seen[i]:  # equal hashes of different windows stand together
                    if np.array_equal(windows[k], numbers[start : start + width]):
                        yield start, width, held[k]
                    k += 1


def scan_text(windows: WindowSet, text: bytes) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Words, marks of the hit words, and items found."""
    words = WORD.findall(text.lower())
    numbers = np.fromiter((windows.vocabulary.get(w, 0) for w in words), np.int64, len(words))
    hit = np.zeros(len(words), bool)
    items: set[int] = set()
    for start, width, held in windows.scan(numbers):
        hit[start : start + width] = True
        items.update(held)
    return words, hit, [windows.names[i] for i in sorted(items)]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, each item whole; one block is on the driver at a time."""
    rows = id_and_text(items, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text")
    )
    held, words = [], 0
    for row in rows.toLocalIterator():
        text = bytes(row["text"] or b"")
        n = len(WORD.findall(text.lower()))
        if held and words + n > block_words:
            yield held
            held, words = [], 0
        held.append((row["name"], text))
        words += n
    yield held


def through_blocks(
    docs: DataFrame, blocks_of_items: Iterator[list[tuple[str, bytes]]], n: int, step: Callable[[DataFrame, Broadcast, bool], DataFrame]
) -> DataFrame:
    """The rows after ``step`` with each block of windows; only the last block stays live in the plan."""
    block = next(blocks_of_items)
    while block is not None:
        after = next(blocks_of_items, None)
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))
        docs = step(docs, shared, after is None)
        if after is not None:
            docs = cut(docs, "decontaminated")
            shared.destroy()
        block = after
    return docs


def _hit_runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


def _scan_block(docs: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
    """Per row: n_words, runs of hit words, items, united with what earlier blocks found; the last drops the text."""
    schema = extended(docs.select("doc_id", *(() if last else ("text",))).schema, **FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                earlier = [part.column(c).to_pylist() if c in part.schema.names else [[]] * len(texts) for c in ("starts", "stops", "items")]
                n_words, starts, stops, items = [], [], [], []
                for text, old_starts, old_stops, old_items in zip(texts, *earlier):
                    words, hit, found = scan_text(shared.value, text)
                    for a, b in zip(old_starts, old_stops):
                        hit[a:b] = True
                    a, b = _hit_runs(hit)
                    n_words.append(len(words))
                    starts.append(a)
                    stops.append(b)
                    items.append(sorted({*old_items, *found}))
                ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
                columns = [pa.array(n_words, pa.int64()), pa.array(starts, ints), pa.array(stops, ints), pa.array(items, strings)]
                kept = ["doc_id"] if last else ["doc_id", "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *FOUND])

    return docs.mapInArrow(run, schema)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated.

    Every row is kept as it is, whatever its doc_id, and passes from block to block with its hits.
    """
    rows = id_and_text(docs, id_col, text_col)
    scan = through_blocks(rows, item_blocks(items, item_col, "text", block_words), n, _scan_block)
    scan = scan.withColumn("n_hit", F.expr("aggregate(arrays_zip(starts, stops), 0L, (s, x) -> s + x.stops - x.starts)"))
    scan = scan.withColumn("items", F.array_sort(F.array_distinct("items")))
    return scan.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", n: int = 10, remove: str = "documents",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of the clean rows; ``remove`` is "documents" (hit rows go) or "spans" (hit words go).

    A span goes from its first to its last hit word. A row is never given up with "spans".
    """
    step = lambda rows, shared, last: _clean_block(rows, shared, text_col, remove == "spans")
    return through_blocks(docs, item_blocks(items, item_col, "text", block_words), n, step)


def without_spans(windows: WindowSet, text: bytes) -> bytes:
    """The text without its hit spans."""
    _, hit, _ = scan_text(windows, text)
    places = [m.span() for m in WORD.finditer(text.lower())] if hit.any() else []
    kept, at = [], 0
    for a, b in zip(*_hit_runs(hit)):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def _clean_block(docs: DataFrame, shared: Broadcast, text_col: str, spans: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text_col):
                if spans:
                    null = part.column(text_col).is_null().to_pylist()
                    new = [None if x else without_spans(shared.value, t).decode() for t, x in zip(texts, null)]
                    at = part.schema.get_field_index(text_col)
                    yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                else:
                    yield part.filter(pa.array([not scan_text(shared.value, t)[1].any() for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


