"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints with at most ``DISTANCE`` = 4 differing bits, cut into three segments,
have a segment that differs in at most one bit (4 bits cannot put 2 into each of three). Every
distinct fingerprint is therefore indexed under 64 keys: each bit in turn is taken out of its
segment, and the key is the rest of that segment plus the bit's place. Fingerprints within the
distance meet under a key with equality and are verified on all 64 bits.

Only what keeps groups connected is emitted. A key with many fingerprints is dealt with by pivots:
everything within the distance of a pivot is linked to it and to nothing else, and what lies
farther is compared with the members of the pivot's ball. Of all links that a task finds it emits
those that connect something new to it (a spanning forest over all its keys), so links are fewer than
the fingerprints a task holds, however dense a group is, and no link between groups is lost. The
fingerprints that one key holds are bounded by their closeness, not by the documents: copies share one.

Null and empty texts have fingerprint zero and link like any other. Rows without a doc_id belong to
groups but cannot name them: a group made of such rows alone has component_id null.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import Forest, blocks, cut, extended, id_and_text
from sieveline.llm.components import connected_components
from sieveline.operators.joins import partitions_of, skew_join

#: Words of a shingle and differing bits of a link.
WORDS, DISTANCE = 4, 4
SEED = 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Shingles whose bits are laid out at once.
SHINGLES_AT_ONCE = 1 << 16
#: Keys with up to so many fingerprints are compared pair by pair.
SMALL_RUN = 8


def simhash(text: bytes, words_per_shingle: int) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(words_per_shingle, len(words))
    starts = [0, *ends[: len(words) - width]]
    stops = ends[width - 1 :]
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        pairs = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE])
        digests = b"".join([xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in pairs])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).view(np.uint64).reshape(-1, 8)
        # Eight counters in each word; 255 rows cannot overflow them.
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text_col: str, words_per_shingle: int, drop_text: bool = False) -> DataFrame:
    """The rows with their fingerprint in ``_fp``."""
    schema = docs.drop(text_col).schema if drop_text else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text_col):
                found = pa.array([simhash(t, words_per_shingle) for t in texts], pa.int64())
                kept = [n for n in part.schema.names if not (drop_text and n == text_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), found], [*kept, "_fp"])

    return docs.mapInArrow(run, extended(schema, _fp=T.LongType()))


def variant_keys(fp):
    """The 64 one-wildcard keys of a fingerprint, as an array of ints."""
    keys = []
    for low, bits in SEGMENTS:
        for bit in range(low, low + bits):
            mask = (((1 << bits) - 1) << low) & ~(1 << bit)
            mask -= (mask >> 63) << 64
            rest = F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask).cast("long")), low)
            keys.append((rest * 64 + bit).cast("int"))
    return F.array(*keys)


def _near(a, b, distance):
    return np.bitwise_count(a ^ b) <= distance


def link_run(run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of one key which are connected within the distance."""
    one, other = [], []
    rest = run
    while rest.size:
        pivot = rest[:1]
        close = _near(rest, pivot, distance)
        ball, rest = rest[close], rest[~close]
        if ball.size == 1:
            continue
        one.append(np.repeat(pivot, ball.size - 1))
        other.append(ball[1:])
        around = run[_near(run, pivot, 2 * distance) & ~_near(run, pivot, distance)]
        for at in range(0, ball.size, 256):
            if not around.size:
                break
            part = ball[at : at + 256]
            step = max(1, (1 << 20) // part.size)
            left = []
            for b in range(0, around.size, step):
                some = around[b : b + step]
                hits = _near(part[:, None], some[None, :], distance)
                met = hits.any(axis=0)
                one.append(part[hits.argmax(axis=0)[met]])
                other.append(some[met])
                left.append(some[~met])
            around = np.concatenate(left)
    if not one:
        return run[:0], run[:0]
    return np.concatenate(one), np.concatenate(other)


def link_sorted(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within all keys of rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, keys.size])
    one, other = [fps[:0]], [fps[:0]]
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    some_keys, some = keys[small], fps[small]
    for k in range(1, min(SMALL_RUN, some.size)):
        hit = (some_keys[k:] == some_keys[:-k]) & _near(some[k:], some[:-k], distance)
        one.append(some[:-k][hit])
        other.append(some[k:][hit])
    for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
        a, b = link_run(fps[start : start + size], distance)
        one.append(a)
        other.append(b)
    return np.concatenate(one), np.concatenate(other)


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Columns u > v: links between distinct fingerprints ``_fp`` that connect each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        keys, fps = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("_fp").to_numpy()]
            if not keys.size:
                continue
            done = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield emit(keys[:done], fps[:done], forest)
            keys, fps = keys[done:], fps[done:]
        yield emit(keys, fps, forest)

    def emit(keys, fps, forest):
        a, b = link_sorted(keys, fps.view(np.uint64), distance) if keys.size > 1 else (fps[:0], fps[:0])
        a, b = a.view(np.int64), b.view(np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1).T.tolist()
        new = np.array([x for x in pairs if forest.join(*x)], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(new[:, 0]), pa.array(new[:, 1])], ["u", "v"])

    # Each row becomes 64, so rows are dealt evenly before, however few bytes they are. A deal by the
    # fingerprint would be taken for the one that its grouping already has.
    even = fingerprints.select("_fp").repartition(partitions_of(fingerprints))
    indexed = even.select("_fp", F.explode(variant_keys(F.col("_fp"))).alias("key"))
    dealt = indexed.repartition("key").sortWithinPartitions("key", "_fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def fingerprint_groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """For each distinct ``_fp`` of (doc_id, _fp) rows: component_id and the group's least fingerprint ``_root``."""
    distinct = cut(rows.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "fingerprints")
    roots = connected_components(links(distinct.select("_fp"), distance))
    rooted = distinct.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left")
    rooted = cut(rooted.select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")), "rooted")
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    # A group may hold a third of all fingerprints.
    return skew_join(rooted, named, "_root", spread_by="_fp").select("_fp", "_root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) of every row."""
    narrow = cut(with_fingerprint(id_and_text(docs, id_col, text_col), "text", words_per_shingle, True), "simhash")
    groups = fingerprint_groups(narrow, distance)
    return narrow.join(groups, "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """One row of each group with all its columns: that of the least (id, fingerprint, text); rows without an id come last.

    Rows with an equal id and an equal text are one document; which of them stays (by a hash of all
    their columns) does not depend on the partitions.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packed = packed.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    narrow = cut(with_fingerprint(packed.select("doc_id", "th", "text"), "text", words_per_shingle, True), "simhash")
    groups = fingerprint_groups(narrow.select("doc_id", "_fp"), distance)
    rooted = narrow.join(groups.select("_fp", "_root"), "_fp")
    least = rooted.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_fp", "th")).alias("x"))
    least = cut(least.select(F.col("x.doc_id").alias("keep_id"), F.col("x.th").alias("keep_th")), "kept")
    same = (packed["th"] == least["keep_th"]) & packed["doc_id"].eqNullSafe(least["keep_id"])
    kept = packed.join(least, same, "left_semi").withColumn("hash", F.xxhash64("row"))
    return kept.groupBy("doc_id", "th").agg(F.min_by("row", "hash").alias("row")).select("row.*")
