"""Periodic runs of words: branching tandem repeats from an enhanced suffix array.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 2 q)`` words long, that no
neighbouring word extends keeping that period. Every run ends with one square (a word sequence of
length q twice) whose two halves are followed by different words or by the end: a branching square.

A task takes the texts of a block together. Suffixes are sorted by prefix doubling with the document
as their first letter, so no two documents mix; the ranks of every doubling step are kept and answer
"how many words from here and from there are equal" in as many look-ups as there are steps. That
gives the common prefixes of neighbours in the suffix array; the LCP interval of each border comes
from the nearest smaller values on both sides. In an interval of depth d, all children but the
largest are gone through: suffix i and suffix i + d (or i - d) begin a branching square if both lie
in the interval, but in different children. The square is then rotated to the left as long as the
word before equals the word a period later, which gives the run; squares of one run with different
periods are merged to the least. All of it is done on arrays; there are no tree nodes.

A text without a repeated sequence of half of ``LEAST`` words holds no run and is not sorted: the
first words of a run come again a period later. Rows are judged each for itself, so nothing is shuffled.

Null and empty texts have no words and no runs. Null and repeated ids are kept as they are; other
columns are ignored. A task holds about 250 bytes per word of the texts of one block (or of one
longer text) at once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, id_and_text

#: Words of the shortest run.
LEAST = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixRanks:
    """Suffix array of several word sequences, none of which shares an order with another.

    ``levels[k][i]`` is the rank of the suffix at i by its first 2^k words; the last one is complete.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        n = words.size
        sizes = stops - starts
        self.n = n
        self.first = np.repeat(starts, sizes)
        self.end = np.repeat(stops, sizes)
        key = np.repeat(np.arange(starts.size), sizes) * (int(words.max(initial=0)) + 1) + words
        self.sa = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.sa] = _group_starts(key[self.sa], np.arange(n))
        self.levels = [rank]
        step = 1
        while True:
            of = rank[self.sa]
            same = of[1:] == of[:-1]
            open_ = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
            if not open_.size:
                break
            at = self.sa[open_]
            ahead = at + step
            second = np.where(ahead < self.end[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[at] * (n + 2) + second
            order = np.argsort(key, kind="stable")
            at = at[order]
            self.sa[open_] = at
            rank = rank.copy()
            rank[at] = _group_starts(key[order], open_)
            self.levels.append(rank)
            step *= 2
        self.isa = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from the places a and b on."""
        found = np.zeros(a.size, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            x, y = a + found, b + found
            inside = (x < self.end[a]) & (y < self.end[b])
            equal = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            found[equal] += 1 << k
        return found

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words that end just before the places a < b of one sequence."""
        found = np.zeros(a.size, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            x, y = a - found - (1 << k), b - found - (1 << k)
            equal = (x >= self.first[a]) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])
            found[equal] += 1 << k
        return found


def _group_starts(sorted_keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the place of the first equal one."""
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return places[np.maximum.accumulate(np.where(new, np.arange(new.size), 0))]


def lcp_intervals(lcp: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix of the LCP interval of each border, by minima over powers of two."""
    n = lcp.size
    table = [lcp]
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    depth = lcp[borders]
    left, right = borders.copy(), borders + 1
    for k in range(len(table) - 1, -1, -1):
        least, width = table[k], 1 << k
        at = left - width
        left = np.where((at >= 0) & (least[np.maximum(at, 0)] >= depth), at, left)
        fits = right + width <= n
        right = np.where(fits & (least[np.where(fits, right, 0)] >= depth), right + width, right)
    return left - 1, right - 1


def branching_squares(ranks: SuffixRanks) -> tuple[np.ndarray, np.ndarray]:
    """Places and half lengths of all branching squares (some more than once)."""
    sa, isa = ranks.sa, ranks.isa
    lcp = np.r_[0, ranks.common(sa[:-1], sa[1:])]
    borders = np.flatnonzero(lcp)
    if not borders.size:
        return borders, borders
    low, high = lcp_intervals(lcp, borders)
    order = np.argsort(low * (sa.size + 1) + high, kind="stable")
    borders, low, high = borders[order], low[order], high[order]
    first = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    number = np.cumsum(first) - 1
    # The children of an interval begin at its first suffix and at each of its borders.
    child_of = np.r_[number[first], number]
    child_start = np.r_[low[first], borders]
    order = np.lexsort((child_start, child_of))
    child_of, child_start = child_of[order], child_start[order]
    low, high, depth = low[first], high[first], lcp[borders[first]]
    last = np.r_[child_of[1:] != child_of[:-1], True]
    child_stop = np.where(last, high[child_of] + 1, np.r_[child_start[1:], 0])
    size = child_stop - child_start
    # All children but the largest.
    by_size = np.lexsort((size, child_of))
    small = np.ones(size.size, bool)
    small[by_size[np.r_[child_of[1:] != child_of[:-1], True]]] = False
    child_of, child_start, child_stop, size = child_of[small], child_start[small], child_stop[small], size[small]
    child = np.repeat(np.arange(size.size), size)
    at = sa[np.arange(child.size) - np.repeat(np.cumsum(size) - size, size) + child_start[child]]
    inner, d = child_of[child], depth[child_of[child]]
    places, halves = [], []
    for other, inside in ((at + d, at + d < ranks.end[at]), (at - d, at - d >= ranks.first[at])):
        y = isa[np.clip(other, 0, sa.size - 1)]
        hit = inside & (y >= low[inner]) & (y <= high[inner]) & ((y < child_start[child]) | (y >= child_stop[child]))
        places.append(np.minimum(at, other)[hit])
        halves.append(d[hit])
    return np.concatenate(places), np.concatenate(halves)


def runs_of(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and period of all runs of the sequences ``words[starts:stops]``, by start, then period."""
    ranks = SuffixRanks(words, starts, stops)
    at, period = branching_squares(ranks)
    stop = at + 2 * period
    start = at - ranks.common_before(at, at + period)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    keep = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])] if start.size else np.zeros(0, bool)
    keep &= stop - start >= np.maximum(least, 2 * period)
    start, stop, period = start[keep], stop[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def with_repeats(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the sequences in which ``width`` words in a row may come twice."""
    n = words.size - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    owner = np.repeat(np.arange(starts.size), stops - starts)
    hashes = owner[:n].astype(np.uint64)
    for k in range(width):
        hashes = (hashes ^ words[k : k + n].astype(np.uint64)) * _MIX
        hashes ^= hashes >> np.uint64(29)
    inside = owner[width - 1 :] == owner[:n]
    hashes, owner = hashes[inside], owner[:n][inside]
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    return np.unique(owner[1:][hashes[1:] == hashes[:-1]])


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as its words; by start, then period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    stops = np.cumsum(sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = with_repeats(words, stops - sizes, stops, max(1, least // 2))
    if chosen.size:
        size = sizes[chosen]
        shift = np.cumsum(size) - size
        some = words[np.arange(size.sum()) - np.repeat(shift - (stops - sizes)[chosen], size)]
        start, stop, period = runs_of(some, shift, shift + size, least)
        owner = np.searchsorted(shift + size, start, "right")
        for k, a, b, p in zip(owner.tolist(), (start - shift[owner]).tolist(), (stop - start).tolist(), period.tolist()):
            found[chosen[k]].append((a, b, p))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period) and collapsed text of every row."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                split = [t.split() for t in texts]
                found = runs_of_texts(split, least)
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                entries = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                left = [collapsed(w, r).decode() for w, r in zip(split, found)]
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(offsets, entries), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; in a tenth of the rows, chosen by the id, the words from some place on repeat.

    With h the crc32 of the decimal id and g = h div 10: if h mod 10 is 0, word i from a = g mod n on is
    word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). A row without an id stays as it is.
    """
    rows = id_and_text(docs, id_col, text_col)
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("_h", hashed).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    )
    # Arguments of the fold: place, then period, from the number of words.
    planted = F.expr(
        "array_join(transform(transform(array(cast(_h div 10 as bigint)), g -> named_struct('g', g, 'a', g % size(_words))),"
        " x -> array_join(transform(_words, (w, i) -> if(i < x.a, w,"
        " element_at(_words, cast(1 + x.a + (i - x.a) % (1 + (size(_words) - x.a) div (3 + x.g % 8)) as int)))), ' ')), '')"
    )
    return rows.select("doc_id", F.when(F.size("_words") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: n_runs, the longest run, and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.array_join(lines, "").alias("lines"), best.alias("best"))
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
