"""Ranked lexical search: best-first document intervals over posting lists with range maxima.

Documents are indexed in shards. A shard numbers its documents in the order of their ids and holds,
for every term that an item asks for, a posting list of document places and term counts. A posting's
impact is the score that the term gives the document; a sparse table over the impacts (maxima over
powers of two) answers which posting of a list is the largest between two places.

A query starts with the interval of all documents of a shard. The bound of an interval is the sum of
the largest impacts that its terms have inside it. The interval with the highest bound is taken next:
it is split at the document of its largest impact, that document is scored, and what lies before and
behind it comes back as two intervals with bounds of their own; an interval with few postings left is
scored whole. The search ends when no bound reaches the k-th best score. Equal scores go to the
smaller id, so an interval with just that score is left out only if its ids are larger. A task carries
the best of each item from shard to shard, and the best of all tasks are merged at the end.

Scoring uses the statistics of the whole corpus: N documents with a term, L terms, document
frequencies. They are sums over all shards and one row per term of the items. Items are taken in
blocks of at most ``block_terms`` terms, so that what is broadcast is bounded; each block makes an index
of its own terms. A shard holds about ``SHARD_POSTINGS`` postings (or one longer text).

Null and empty texts have no terms, score nothing and do not count in N. Rows with an equal doc_id are
documents of their own; rows without one are ranked behind equal scores and come back as null. Rows
with an equal item_id (null too) are one item with the terms of all. Ids must be integers; other
columns are ignored. An item that no document answers has no rows.
"""

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, cut, id_and_text

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms of one block of items, with repeats.
BLOCK_TERMS = 2_000_000
SHARD_POSTINGS = 1_000_000
#: Intervals with up to so many postings are scored whole.
LEAF = 4096
#: Stands for a missing id, behind all others.
NO_ID = (1 << 63) - 1
INDEX = "doc_ids array<long>, sizes array<long>, terms array<int>, counts array<int>, places binary, tf binary, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


class ShardBuilder:
    """Collects documents and gives the shard as one row of the index."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.n_docs = self.n_terms = 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.postings, self.held = [], [], [], 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        get, numbers, sizes = self.vocabulary.get, [], []
        for t in texts:
            found = terms_of(t)
            sizes.append(len(found))
            numbers += [get(w, -1) for w in found]
        sizes, numbers = np.array(sizes, np.int64), np.array(numbers, np.int64)
        self.n_docs += int((sizes > 0).sum())
        self.n_terms += int(sizes.sum())
        width = len(self.vocabulary) + 1
        owner = np.repeat(np.arange(sizes.size), sizes)[numbers >= 0]
        keys, tf = np.unique(owner * width + numbers[numbers >= 0], return_counts=True)
        # Only documents that hold a term are numbered.
        used, at = np.unique(keys // width, return_inverse=True)
        self.postings.append((at + len(self.ids), keys % width, tf))
        self.ids += [NO_ID if ids[i] is None else ids[i] for i in used.tolist()]
        self.sizes += sizes[used].tolist()
        self.held += keys.size

    def row(self) -> pa.RecordBatch:
        """The documents so far as a batch of one row; the builder is empty afterwards."""
        doc, term, tf = (np.concatenate(c) if self.postings else np.empty(0, np.int64) for c in zip(*self.postings or [((), (), ())]))
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        doc = place[doc.astype(np.int64)]
        by_term = np.lexsort((doc, term))
        names, counts = np.unique(term, return_counts=True)
        lists = [[self.ids[i] for i in order.tolist()], [self.sizes[i] for i in order.tolist()]]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        columns = [pa.array([x], longs) for x in lists]
        columns += [pa.array([names.astype(np.int32)], ints), pa.array([counts.astype(np.int32)], ints)]
        columns += [pa.array([doc[by_term].astype("<u4").tobytes()], pa.binary()), pa.array([tf[by_term].astype("<u4").tobytes()], pa.binary())]
        columns += [pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64())]
        self.n_docs = self.n_terms = 0
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sizes", "terms", "counts", "places", "tf", "n_docs", "n_terms"])


def index_shards(docs: DataFrame, vocabulary: dict[bytes, int], shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row per shard with the postings of the vocabulary; every document is in one shard."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(shared.value)
        for batch in batches:
            for part, texts in blocks(batch):
                shard.add(part.column("doc_id").to_pylist(), texts)
                if shard.held >= shard_postings:
                    yield shard.row()
        yield shard.row()

    return docs.mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Corpus:
    """Statistics of all documents; ``weights`` by the number of the term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def corpus_statistics(index: DataFrame, vocabulary: dict[bytes, int]) -> Corpus:
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.toLocalIterator():  # one row per term of the block
        weights[row["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    return Corpus(n_docs, n_terms, weights)


class Shard:
    """The posting lists of a shard with their impacts and range maxima."""

    def __init__(self, row: dict, corpus: Corpus):
        self.ids = np.array(row["doc_ids"], np.int64)
        places, tf = np.frombuffer(row["places"], "<u4").astype(np.int64), np.frombuffer(row["tf"], "<u4").astype(np.int64)
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        slack = 10 + (90 * np.array(row["sizes"], np.int64) * corpus.n_docs) // max(1, corpus.n_terms)
        impact = np.repeat(corpus.weights[terms], counts) * ((1_000_000_000 * tf) // (1000 * tf + 8 * slack[places]))
        self.places, self.impact = places, impact
        stops = np.cumsum(counts)
        self.list_of = {t: k for k, t in enumerate(terms.tolist())}
        self.starts, self.stops = stops - counts, stops
        # Sorted by list, then place: one search finds a place in many lists.
        self.keys = np.repeat(np.arange(terms.size), counts) * (self.ids.size + 1) + places
        self.best = [np.arange(impact.size)]
        while 2 << (len(self.best) - 1) <= counts.max(initial=0):
            a, b = self.best[-1][: -(1 << (len(self.best) - 1))], self.best[-1][1 << (len(self.best) - 1) :]
            self.best.append(np.where(impact[a] >= impact[b], a, b))
        self.width = max(1, max(map(len, self.best)))
        self.table = np.zeros((len(self.best), self.width), np.int64)
        for k, level in enumerate(self.best):
            self.table[k, : level.size] = level

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The posting of the largest impact in each non-empty range of postings."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        a, b = self.table[k, low], self.table[k, high - (1 << k)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def bounded(self, low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
        """The sum of the largest impacts of the ranges, and the place of the largest of them."""
        held = high > low
        if not held.any():
            return 0, -1
        best = self.largest(low[held], high[held])
        values = self.impact[best]
        return int(values.sum()), int(self.places[best[values.argmax()]])

    def search(self, terms: list[int], kept: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The ``top`` best (score, id) of those kept so far and of this shard, best first."""
        lists = np.array([self.list_of[t] for t in terms if t in self.list_of], np.int64)
        if not lists.size:
            return kept
        best = [(s, -i) for s, i in kept]  # the root is the worst
        heapq.heapify(best)

        def offer(score: int, place: int) -> None:
            entry = (score, -int(self.ids[place]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)

        def hopeless(bound: int, first: int) -> bool:
            return bound <= 0 or len(best) == top and (bound, -int(self.ids[first])) <= best[0]

        waiting: list = []

        def push(first: int, low: np.ndarray, high: np.ndarray) -> None:
            bound, split = self.bounded(low, high)
            if split >= 0 and not hopeless(bound, first):
                heapq.heappush(waiting, (-bound, first, split, low, high))

        push(0, self.starts[lists], self.stops[lists])
        while waiting:
            bound, first, split, low, high = heapq.heappop(waiting)
            if len(best) == top and -bound < best[0][0]:
                break
            if hopeless(-bound, first):
                continue
            sizes = high - low
            total = int(sizes.sum())
            if total <= LEAF:
                at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
                places, owner = np.unique(self.places[at], return_inverse=True)
                scores = np.zeros(places.size, np.int64)
                np.add.at(scores, owner, self.impact[at])
                for i in np.lexsort((places, -scores))[:top].tolist():
                    if scores[i] > 0:
                        offer(int(scores[i]), int(places[i]))
                continue
            middle = np.clip(np.searchsorted(self.keys, lists * (self.ids.size + 1) + split), low, high)
            hit = (middle < high) & (self.places[np.minimum(middle, self.places.size - 1)] == split)
            offer(int(self.impact[middle[hit]].sum()), split)
            push(first, low, middle)
            if split + 1 < self.ids.size:
                push(split + 1, middle + hit, high)
        return sorted([(s, -i) for s, i in best], key=lambda x: (-x[0], x[1]))


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of bounded size; one block is on the driver at a time."""
    rows = id_and_text(items, item_col, text_col).groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    held, size = [], 0
    for row in rows.orderBy("doc_id").toLocalIterator():
        terms = sorted(set(terms_of(row["text"].encode())))
        if held and size + len(terms) > block_terms:
            yield held
            held, size = [], 0
        held.append((row["doc_id"], terms))
        size += len(terms)
    if held:
        yield held


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], top: int, shard_postings: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    index = cut(index_shards(docs, vocabulary, shard_postings), "search-index")
    corpus = corpus_statistics(index, vocabulary)
    asked = [(i, [vocabulary[t] for t in terms]) for i, terms in items]
    shared = docs.sparkSession.sparkContext.broadcast((asked, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, corpus = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not row["doc_ids"]:
                    continue
                shard = Shard(row, corpus)
                for i, (_, terms) in enumerate(asked):
                    best[i] = shard.search(terms, best[i], top)
        rows = [(item, None if doc == NO_ID else doc, score) for (item, _), found in zip(asked, best) for score, doc in found]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return index.drop("n_docs", "n_terms").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of each item with a score above 0."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = items.withColumn(item_col, F.col(item_col).cast("long"))
    found = None
    for block in item_blocks(asked, item_col, item_text_col, block_terms):
        part = cut(_search_block(rows, block, top, shard_postings), "search-best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
