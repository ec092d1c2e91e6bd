"""Exact Jaccard self-join of word shingles by T-occurrence search.

Two sets link if their similarity is at least ``percent`` hundredths; a set then shares at least
T = ceil(percent / 100 x its size) shingles with any partner. Sets are equal texts' only once.

1. Narrowing. In the order of their hashes, a set's first (size - T + c) shingles hold c of those it
   shares with a partner. So a set that has no shingle in common with others among the rarest of
   them has no partner. Tasks send each shingle of these prefixes once, with its set if it is the only
   one of the task, so a frequent shingle costs one entry per task.
2. The sets left count all their shingles among each other; the (size - T + 1) rarest of a set hold
   one it shares with a partner. Sets that meet there, with sizes that allow a link, are connected to
   the least of them; the connected components are the neighbourhoods within which links can be.
3. A neighbourhood is cut into groups of at most ``CELL_SHINGLES`` shingles by size, and every two groups
   whose sizes allow a link make a cell. A task searches one cell at a time (DivideSkip): each set is
   a query on the inverted lists of the cell; its L longest lists are put aside, the others are
   merged on a heap (by counting, where they are many), sets met T - L times remain, and the long
   lists are probed for those by binary search. What reaches the required overlap is a link.

Of the links a task emits those that connect something new to it (a spanning forest), so a dense
group costs links in proportion to its sets. A neighbourhood larger than a cell costs its sets once
per group, which is quadratic only beyond that size.

Rows without words, null texts included, have an empty set and link with nothing, not even each
other. Rows without an id belong to components but cannot name them; a component of such rows alone
has component_id null. Repeated ids and rows count each for itself; other columns are ignored.
Shingles are 64-bit hashes of their words.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Forest, blocks, cut, id_and_text
from sieveline.llm.components import connected_components
from sieveline.operators.joins import partitions_of, skew_join

WORDS, PERCENT = 5, 80
#: c of the narrowing is one shingle and one in so many of the set.
EXTRA = 7
#: Prefix entries that a task gathers before it sends them.
GATHERED = 4_000_000
CELL_SHINGLES = 1 << 15
#: Bits of the table of wanted texts that scans are filtered by (2^26: 8 MB); a full one filters nothing.
WANTED_BITS = 26
#: Cost of a probe against a merge step in the choice of L.
PROBE = 0.0085
#: Entries of short lists up to which they are merged on a heap.
HEAPED = 256
#: Words whose hashes a worker remembers.
REMEMBERED = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()


def shingles(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of one with fewer words, its whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(words_per_shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(found: np.ndarray) -> int:
    """The number of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set shares with any partner at least."""
    return -(-percent * size // 100)


def required_overlap(a, b, percent: int):
    """Common shingles from which two sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def extra_of(size: int) -> int:
    return 1 + size // EXTRA


def prefix_length(size: int, percent: int) -> int:
    return min(size, size - least_overlap(size, percent) + extra_of(size))


def rarest_length(size: int, percent: int) -> int:
    """Of the prefix, so many rarest shingles hold one that a partner has among its own."""
    return prefix_length(size, percent) - extra_of(least_overlap(size, percent)) + 1


# ---- narrowing --------------------------------------------------------------------------------


ENTRIES = ["doc_id", "th", "node", "n", "part", "hashes", "nodes", "counts"]


def _dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys by partition, in order of the keys."""
    at = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, at))
    edges = np.searchsorted(at[order], np.arange(parts + 1))
    return ((p, order[a:b]) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b)


def _packed(id_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, hashes, nodes, counts) without a document."""
    none = [pa.nulls(len(rows), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([*none, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ENTRIES)


def _packed_counts(nodes: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    dealt = _dealt(nodes.view(np.uint64), parts)
    return [(p, None, nodes[at].tobytes(), counts[at].astype("<i8").tobytes()) for p, at in dealt]


def prefix_entries(docs: DataFrame, words_per_shingle: int, percent: int, parts: int) -> DataFrame:
    """Rows of three kinds: a document (doc_id, th, node, n), prefix shingles and counts packed for a partition.

    Prefix shingles go by their hash, each with the only set of the task that has it, or with the
    number 0 if there are several; of the hash, 32 bits are sent, which can only make a shingle look
    shared. How many shingles a set shares inside its task goes by the set.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def send(id_type: pa.DataType, prefixes: dict[int, np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.fromiter(prefixes, np.int64, len(prefixes)), [p.size for p in prefixes.values()])
        hashes = np.concatenate(list(prefixes.values()))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.r_[True, hashes[1:] != hashes[:-1]]
        alone = first & np.r_[first[1:], True]
        rows = _packed_counts(*np.unique(owner[~alone], return_counts=True), parts)
        hashes, owner = hashes[first], np.where(alone, owner, 0)[first]
        for p, at in _dealt(hashes, parts):
            at = at[np.argsort(owner[at], kind="stable")]  # equal numbers side by side take little room
            rows.append((p, (hashes[at] >> np.uint64(24)).astype("<u4").tobytes(), owner[at].tobytes(), None))
        return _packed(id_type, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: dict[int, np.ndarray] = {}
        id_type, held, seen = pa.null(), 0, 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for piece, texts in blocks(batch):
                nodes, counts = [], []
                for t in texts:
                    s = shingles(t, words_per_shingle)
                    node = node_of(s) if s.size else None
                    nodes.append(node)
                    counts.append(s.size)
                    if node is not None and node not in prefixes:
                        prefixes[node] = s[: prefix_length(s.size, percent)].copy()
                        held += prefixes[node].size
                n = len(texts)
                turn = pa.array((np.arange(seen, seen + n) % parts).astype(np.int32))
                seen += n
                columns = [piece.column("doc_id"), piece.column("th"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), turn]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.binary())] * 3], ENTRIES)
                if held >= GATHERED:
                    yield send(id_type, prefixes)
                    prefixes, held = {}, 0
        if prefixes:
            yield send(id_type, prefixes)

    schema = f"doc_id {kind}, th long, node long, n long, part int, hashes binary, nodes binary, counts binary"
    return docs.mapInArrow(run, schema)


def settled_entries(entries: DataFrame, parts: int) -> DataFrame:
    """The same rows with counts in place of the packed shingles: of those that sets of several tasks have."""

    def settle(hashes: list[np.ndarray], nodes: list[np.ndarray]) -> list[tuple]:
        h, owner = np.concatenate(hashes), np.concatenate(nodes)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]  # a set in several tasks is one
        h, owner, several = h[new], owner[new], owner[new] == 0
        first = np.r_[True, h[1:] != h[:-1]]
        alone = first & np.r_[first[1:], True]
        return _packed_counts(*np.unique(owner[~alone & ~several], return_counts=True), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, part, hashes, nodes = pa.null(), None, [], []
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            packed = batch.column("hashes").is_valid()
            yield batch.filter(packed.to_numpy(zero_copy_only=False) == 0)
            some = batch.filter(packed)
            for p, h, n in zip(*(some.column(c).to_pylist() for c in ("part", "hashes", "nodes"))):
                if p != part and hashes:
                    yield _packed(id_type, settle(hashes, nodes))
                    hashes, nodes = [], []
                part = p
                hashes.append(np.frombuffer(h, "<u4"))
                nodes.append(np.frombuffer(n, np.int64))
        if hashes:
            yield _packed(id_type, settle(hashes, nodes))

    return entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, entries.schema)


def shared_counts(found: DataFrame, parts: int) -> DataFrame:
    """node, shared: prefix shingles of each set that others have too, from packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            nodes += [np.frombuffer(x, np.int64) for x in batch.column("nodes").to_pylist()]
            counts += [np.frombuffer(x, "<i8") for x in batch.column("counts").to_pylist()]
        names, at = np.unique(np.concatenate(nodes), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts), names.size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], ["node", "shared"])

    packed = found.where("counts is not null").select("part", "nodes", "counts")
    return packed.repartition(parts, "part").mapInArrow(run, "node long, shared long")


def narrowed(found: DataFrame, nodes: DataFrame, percent: int, parts: int) -> DataFrame:
    """The nodes (node, n, th) that may have a partner."""
    size = F.col("n")
    least = lambda n: F.ceil(F.lit(percent) * n / 100)
    extra = lambda n: 1 + F.floor(n / EXTRA)
    prefix = F.least(size, size - least(size) + extra(size))
    rarest = prefix - extra(least(size)) + 1
    return nodes.join(shared_counts(found, parts), "node").where(F.col("shared") > prefix - rarest).select("node", "n", "th")


# ---- neighbourhoods ---------------------------------------------------------------------------


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``th`` may be among the wanted ones, by a bit table of fixed size."""
    place = F.pmod(F.xxhash64("th"), F.lit(1 << WANTED_BITS))
    rows = wanted.select(place.alias("place")).groupBy(F.expr("place div 32768").alias("bucket"))
    table = np.zeros(1 << (WANTED_BITS - 3), np.uint8)
    for r in rows.agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits")).toLocalIterator():
        table[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    marked = docs.select("th", "text", place.alias("place"))
    return marked.mapInArrow(run, marked.schema).select("th", "text")


def sets_of(docs: DataFrame, nodes: DataFrame, words_per_shingle: int) -> DataFrame:
    """node, n, found (sorted hashes) of the nodes, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                found = [shingles(t, words_per_shingle).view(np.int64) for t in texts]
                columns = [part.column("node"), part.column("n"), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "found"])

    one_each = wanted_texts(docs, nodes).dropDuplicates(["th"]).join(nodes, "th").select("node", "n", "text")
    return one_each.mapInArrow(run, "node long, n long, found array<bigint>").dropDuplicates(["node"])


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """key, node, n: of each set the rarest shingles, one of which any partner has among its own."""
    entries = sets.select("node", "n", F.explode("found").alias("key"))
    often = entries.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = entries.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    # What only one set has is rarer and leads nowhere; the rest of the prefix are the rarest of these.
    left = F.size("keys") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    chosen = known.where(left > 0).withColumn("keys", F.slice("keys", 1, left.cast("int")))
    return chosen.select("node", "n", F.explode("keys.key").alias("key"))


def size_step(percent: int):
    """A class of sizes ``n``: those of two linked sets differ by one at most."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 * 100 / percent)).cast("long")


def meetings(keys: DataFrame, percent: int) -> DataFrame:
    """Columns u > v: each set with the least of those it meets under a key at nearly its size."""
    step = size_step(percent)
    hubs = keys.withColumn("step", F.explode(F.array(step, step + 1))).select(F.xxhash64("key", "step").alias("hub"), "node")
    least = hubs.groupBy("hub").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v <> most")
    return hubs.join(least.select("hub", "v"), "hub").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def cells(neighbours: DataFrame, percent: int, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """cell, side, node for (node, n, root) rows: every cell in which a node is searched."""
    rows = neighbours.withColumn("step", size_step(percent))
    by_step = rows.groupBy("root", "step").agg(F.sum("n").alias("load"))
    # One entry for each step of size in a neighbourhood, a few dozen.
    plan = by_step.groupBy("root").agg(
        F.sum("load").alias("load"),
        F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("load") / cell_shingles).cast("long").alias("s")))).alias("salts"),
    )
    placed = skew_join(rows, plan, "root", spread_by="node")
    salts = lambda k: F.coalesce(F.col("salts")[F.col("step") + k], F.lit(0))
    groups = lambda k: F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), salts(k)), lambda i: i < salts(k)), lambda i: F.struct((F.col("step") + k).alias("s"), i.alias("i"))
    )
    own = F.struct(F.col("step").alias("s"), F.pmod(F.xxhash64("node"), salts(0)).alias("i"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("i")))
    small = F.col("load") <= cell_shingles
    placed = placed.select(
        "root", "node", F.when(small, whole[0]).otherwise(own).alias("own"),
        F.explode(F.when(small, whole).otherwise(F.concat(groups(-1), groups(0), groups(1)))).alias("other"),
    )
    first = F.col("own") <= F.col("other")
    cell = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(first, 1).otherwise(2)
    return placed.select(cell.alias("cell"), side.cast("int").alias("side"), "node")


# ---- search -----------------------------------------------------------------------------------


class InvertedLists:
    """The lists of a cell: for each shingle that several sets have, the places of these in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([s.size for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, names, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = counts[names] > 1
        order = np.argsort(names[common], kind="stable")  # within a list, places ascend
        self.places = owner[common][order]
        renamed = np.cumsum(counts > 1) - 1
        self.lists = renamed[names[common]]
        self.lengths = counts[counts > 1]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.edges = np.r_[0, np.cumsum(np.bincount(owner[common], minlength=len(sets)))]
        # Sorted by list, then place: one search finds where a place stands in many lists.
        self.width = len(sets) + 1
        self.keys = np.repeat(np.arange(self.lengths.size), self.lengths) * self.width + self.places

    def of(self, place: int) -> np.ndarray:
        """The lists that the set at this place is in, shortest first."""
        mine = self.lists[self.edges[place] : self.edges[place + 1]]
        return mine[np.argsort(self.lengths[mine], kind="stable")]


def merge(index: InvertedLists, short: np.ndarray, upto: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places before ``upto`` that stand in at least ``least`` of the short lists, and in how many."""
    starts = index.starts[short]
    stops = np.searchsorted(index.keys, short * index.width + upto)
    sizes = stops - starts
    total = int(sizes.sum())
    if total <= HEAPED:
        places, counts, last, run = [], [], -1, 0
        pieces = [index.places[a:b].tolist() for a, b in zip(starts.tolist(), stops.tolist()) if a < b]
        for place in heapq.merge(*pieces):
            if place != last:
                if run >= least and run:
                    places.append(last)
                    counts.append(run)
                last, run = place, 0
            run += 1
        if run >= least and run:
            places.append(last)
            counts.append(run)
        return np.array(places, np.int64), np.array(counts, np.int64)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    counts = np.bincount(index.places[at], minlength=1)
    places = np.flatnonzero(counts >= max(1, least))
    return places, counts[places]


def search(sets: list[np.ndarray], apart, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets given in order of size; ``apart(a, places)`` says which of them need a look.

    Every pair is met once, with the larger set as the query.
    """
    index = InvertedLists(sets)
    sizes = np.array([s.size for s in sets], np.int64)
    longest = int(index.lengths.max(initial=1))
    for q in range(1, len(sets)):
        lists = index.of(q)
        least = least_overlap(int(sizes[q]), percent)
        if lists.size < least:
            continue
        aside = min(least - 1, int(least / (PROBE * math.log2(longest + 1) + 1)))
        aside = max(0, min(aside, lists.size))
        short, long = lists[: lists.size - aside], lists[lists.size - aside :]
        places, counts = merge(index, short, q, least - aside)
        fits = sizes[places] * 100 >= percent * int(sizes[q])
        places, counts = places[fits], counts[fits]
        look = apart(q, places)
        places, counts = places[look], counts[look]
        if not places.size:
            continue
        needed = required_overlap(sizes[places], int(sizes[q]), percent)
        for at in range(0, long.size, 64):
            some = long[at : at + 64]
            rest = long.size - at
            open_ = (counts < needed) & (counts + rest >= needed)
            if not open_.any():
                break
            keys = (some[:, None] * index.width + places[open_][None, :]).ravel()
            found = np.searchsorted(index.keys, keys)
            hit = (index.keys[np.minimum(found, index.keys.size - 1)] == keys).reshape(some.size, -1)
            counts[open_] += hit.sum(axis=0)
        for place in places[counts >= needed].tolist():
            yield q, place


def links(searched: DataFrame, percent: int, parts: int) -> DataFrame:
    """Columns u > v: links that connect every group, from (cell, side, node, n, found) rows."""

    def cell_links(rows: list[tuple[int, int, int, np.ndarray]], forest: Forest) -> Iterator[tuple[int, int]]:
        rows.sort(key=lambda r: (r[2], r[1]))
        nodes, sides = [r[1] for r in rows], np.array([r[0] for r in rows])
        sets = [r[3] for r in rows]

        def apart(q: int, places: np.ndarray) -> np.ndarray:
            root = forest.find(nodes[q])
            other = (sides[places] != sides[q]) | (sides[q] == 0)
            return np.array([bool(o) and forest.find(nodes[p]) != root for o, p in zip(other, places.tolist())], bool)

        for a, b in search(sets, apart, percent):
            if forest.join(nodes[a], nodes[b]):
                yield max(nodes[a], nodes[b]), min(nodes[a], nodes[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        cell, rows = None, []

        def emit() -> pa.RecordBatch:
            found = list(cell_links(rows, forest)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            flat, offsets = batch.column("found").values.to_numpy(), batch.column("found").offsets.to_numpy()
            lists = zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "node", "n")))
            for (c, side, node, n), a, b in zip(lists, offsets[:-1].tolist(), offsets[1:].tolist()):
                if c != cell:
                    yield emit()
                    cell, rows = c, []
                rows.append((side, node, n, flat[a:b].copy()))
        yield emit()

    dealt = searched.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def node_components(docs: DataFrame, nodes: DataFrame, found: DataFrame, words_per_shingle: int, percent: int, parts: int) -> DataFrame:
    """node, root of the nodes that link to another."""
    left = cut(narrowed(found, nodes, percent, parts), "narrowed")
    sets = cut(sets_of(docs, left, words_per_shingle), "shingle-sets")
    met = connected_components(cut(meetings(cut(rare_keys(sets, percent), "rare-keys"), percent), "meetings"))
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    neighbours = cut(sets.select("node", "n").join(met, "node"), "neighbours")
    searched = cut(cells(neighbours, percent), "cells").join(sets, "node")
    return connected_components(cut(links(searched, percent, parts), "jaccard-links"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) of every row."""
    parts = partitions_of(docs)
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    found = cut(settled_entries(prefix_entries(texts, words_per_shingle, percent, parts), parts), "prefixes")
    rows = found.where("n is not null").select("doc_id", "th", "node", "n")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("n").alias("n"))
    nodes = cut(nodes, "shingle-nodes")
    roots = node_components(texts, nodes, found, words_per_shingle, percent, parts)
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = cut(skew_join(rooted, named, "root", spread_by="node").select("node", "component_id"), "members")
    joined = skew_join(rows.withColumn("at", F.xxhash64("doc_id", "th")), members, "node", "left", spread_by="at")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
