"""Exact repeated-substring removal by merging sorted suffixes of shards.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is marked. Only suffixes
at anchors are sorted: of the ``GRAM``-byte strings inside each window of ``LENGTH`` bytes those with the
least hash (all of them if equal). Equal windows have equal anchors at equal places, so a repeated
window is found among the suffixes at the anchors that it holds, and only anchors whose string
occurs twice in the corpus have to take part.

Each task (shard) cuts the two-sided context of its anchors and sorts them by what follows: its
piece of the suffix array, with what precedes, the transform's symbols, beside it. Where shards meet,
the runs of an anchor string are merged by refinement of their interleave: starting from the runs one
after the other, each step splits every block of so far equal suffixes by its next byte, stably, so
that runs stay in order and only the interleave changes. The step at which a border appears is the
longest common prefix there. What precedes is refined the same way. A window that starts ``b`` bytes
before its anchor is then repeated if another suffix lies in the same interval of common prefix
``LENGTH - b`` and in the same interval of ``b`` preceding bytes.

Equal texts take part once and are repeated as a whole if they have ``LENGTH`` bytes. Equal contexts of
a shard are one suffix. Anchor strings that occur more than ``HOT`` times are split by where the
window starts and by the bytes that all such windows share. Where these bytes stand in more than
``HOT`` texts too, the part is split again to single windows: the context is then the window itself,
whatever surrounds it, and a task sends an equal one at most twice (unless it has met ``MET`` others
in between). Null texts are empty, ids may be null or repeated, and
other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, cut, id_and_text

LENGTH, GRAM = 400, 160
#: Occurrences in different texts above which an anchor string is split, and window starts per part.
HOT, PART = 2_000, 48
#: Single windows that a task remembers.
MET = 200_000
#: Bytes whose hashes are laid out at once; contexts merged at once (or one larger group).
LAID_OUT, MERGED = 1 << 19, 16_384
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CONTEXT = "block long, shard int, rank int, before binary, after binary, weight int, key binary, pos long, stop long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _sliding(values: np.ndarray, width: int, extreme) -> np.ndarray:
    """The extreme of every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = extreme(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return extreme(values[: len(values) - rest], values[rest:]) if rest else values


def anchors_laid_out(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int):
    """Places and hashes of the anchors in a buffer of texts with the given borders."""
    n = len(data) - gram + 1
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * inverse[:n]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX)
    hashes = (hashes ^ (hashes >> np.uint64(32))) | np.uint64(1)
    width = length - gram + 1
    least = _sliding(hashes, width, np.minimum)
    inside = np.zeros(len(data) + 1, np.int32)
    whole = stops - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, stops[whole] - length + 1, -1)
    least[np.cumsum(inside[: len(least)]) == 0] = 0
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(padded, width, np.maximum) == hashes)
    return places, hashes[places].view(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the anchors of each text."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    out = [none] * len(texts)
    group, held = [], 0
    for i, text in enumerate(texts):
        if len(text) > LAID_OUT:
            found = {}
            for at in range(0, len(text) - length + 1, LAID_OUT):
                piece = np.frombuffer(text[at : at + LAID_OUT + length - 1], np.uint8)
                places, hashes = anchors_laid_out(piece, np.array([0]), np.array([len(piece)]), length, gram)
                found.update(zip((places + at).tolist(), hashes.tolist()))
            places = np.array(sorted(found), np.int64)
            out[i] = (places, np.array([found[p] for p in places.tolist()], np.int64))
        elif len(text) >= length:
            group.append(i)
            held += len(text)
        if group and (held > LAID_OUT or i == len(texts) - 1):
            _anchors_of_group(texts, group, out, length, gram)
            group, held = [], 0
    if group:
        _anchors_of_group(texts, group, out, length, gram)
    return out


def _anchors_of_group(texts, group, out, length, gram):
    stops = np.cumsum([len(texts[i]) for i in group])
    starts = np.r_[0, stops[:-1]]
    data = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
    places, hashes = anchors_laid_out(data, starts, stops, length, gram)
    borders = np.searchsorted(places, np.r_[starts, len(data)])
    for k, i in enumerate(group):
        part = slice(borders[k], borders[k + 1])
        out[i] = (places[part] - starts[k], hashes[part])


def refine(blocks_of: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of suffixes and the common prefix of each with the one before it in its block.

    ``blocks_of`` numbers the block of each row, ascending; a row of ``symbols`` has the bytes of a
    suffix. The first row of a block has -1.
    """
    n, depth = symbols.shape
    order = np.arange(n)
    common = np.full(n, depth, np.int64)
    first = np.r_[True, blocks_of[1:] != blocks_of[:-1]]
    common[first] = -1
    alone = first & np.r_[first[1:], True]
    active = np.flatnonzero(~alone)  # places in the order that are not settled
    border = first[active]
    for step in range(depth):
        if not active.size:
            break
        rows = order[active]
        byte = symbols[rows, step].astype(np.int64)
        keys = (np.cumsum(border) << 8) | byte
        if (keys[1:] < keys[:-1]).any():
            moved = np.argsort(keys, kind="stable")
            order[active] = rows[moved]
            keys = keys[moved]
        changed = np.r_[True, keys[1:] != keys[:-1]]
        common[active[changed & ~border]] = step
        border = changed
        alone = border & np.r_[border[1:], True]
        if alone.any():
            active, border = active[~alone], border[~alone]
    return order, common


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)


def repeated_windows(
    block: np.ndarray, before: list[bytes], after: list[bytes], weight: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first start, last start) of repeated windows, as bytes before the anchor of each row."""
    n = len(block)
    ahead = np.array([len(s) for s in after])
    behind = np.array([len(s) for s in before])
    widest = int(behind.max(initial=0))
    right_order, right = refine(block, _matrix(after, max(1, int(ahead.max(initial=0)))))
    left_order, left = refine(block, _matrix([s[::-1] for s in before], max(1, widest)))
    right_of, left_of = np.empty(n, np.int64), np.empty(n, np.int64)
    closest_right, closest_left = np.empty(n, np.int64), np.empty(n, np.int64)
    closest_right[right_order] = np.maximum(right, np.r_[right[1:], -1])
    closest_left[left_order] = np.maximum(left, np.r_[left[1:], -1])
    marks = np.zeros((n, widest + 2), bool)
    for b in range(widest + 1):
        fits = (behind >= b) & (ahead >= length - b)
        marks[:, b] = fits & (weight > 1)
        rows = np.flatnonzero(fits & (closest_left >= b) & (closest_right >= length - b))
        if rows.size < 2:
            continue
        right_of[right_order] = np.cumsum(right < length - b)
        left_of[left_order] = np.cumsum(left < b)
        both = right_of[rows] * (n + 1) + left_of[rows]
        order = np.argsort(both)
        both = both[order]
        same = both[1:] == both[:-1]
        marks[rows[order[np.r_[same, False] | np.r_[False, same]]], b] = True
    edges = np.diff(np.pad(marks, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    yield rows, first, last


def _parts(length, gram):
    widest = length - gram
    return [(s, min(s + PART - 1, widest)) for s in range(0, widest + 1, PART)]


def _shared_block(text, pos, low, high, length):
    """The block of a part of a hot anchor: the bytes that all its windows share; None where no window fits."""
    if pos < low or max(0, pos - high) + length > len(text):
        return None
    return xxhash.xxh64_intdigest(text[pos - low : pos - high + length], seed=low) - (1 << 63)


def _contexts(texts, keys, copies, found, hot_parts, length, gram):
    """The contexts of the wanted anchors of some texts, each with the places where it stands.

    A context is (block, after, before, single); ``single`` ones hold one window.
    """
    widest, split = length - gram, _parts(length, gram)
    seen: dict[tuple[int, bytes, bytes, bool], list] = {}
    for text, key, n_copies, wanted, hot, (places, hashes) in zip(texts, keys, copies, found, hot_parts, anchors(texts, length, gram)):
        is_hot, hot = {a["h"]: a["hot"] for a in wanted}, set(hot or ())
        for pos, h in zip(places.tolist(), hashes.tolist()):
            if h not in is_hot:
                continue
            parts = split if is_hot[h] else [(0, widest)]
            for low, high in parts:
                before, after = text[max(0, pos - high) : pos], text[pos : pos + length - low]
                if len(before) < low or len(before) + len(after) < length:
                    continue
                block = h
                if is_hot[h]:
                    block = _shared_block(text, pos, low, high, length)
                if is_hot[h] and block in hot:
                    for b in range(low, high + 1):
                        window = text[pos - b : pos - b + length] if pos >= b else b""
                        if len(window) == length:
                            block = xxhash.xxh64_intdigest(window, seed=PART + b) - (1 << 63)
                            seen.setdefault((block, window[b:], window[:b], True), []).append((key, pos, n_copies))
                    continue
                seen.setdefault((block, after, before, False), []).append((key, pos, n_copies))
    return seen


def _shared_blocks(text, found, places, hashes, length, gram):
    """The blocks of all parts of the hot anchors of a text."""
    hot = {a["h"] for a in found if a["hot"]}
    places = [p for p, h in zip(places.tolist(), hashes.tolist()) if h in hot]
    return {_shared_block(text, p, low, high, length) for p in places for low, high in _parts(length, gram)} - {None}


def find_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text, key) and, for those with repeated windows, (key, doc_id, spans)."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit("")))
    # A key that cannot be null keeps both joins on one exchange of the texts.
    key = F.coalesce(F.substring(F.unhex(F.sha2("text", 256)), 1, 16), F.lit(bytearray()))
    keyed = keyed.withColumn("key", key)
    long_enough = keyed.where(F.octet_length("text") >= length)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                found = [np.unique(h, return_counts=True) for _, h in anchors(texts, length, gram)]
                longs = pa.list_(pa.int64())
                columns = [part.column("doc_id"), part.column("key")]
                columns += [pa.array([f[i] for f in found], longs) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "h", "times"])

    schema = f"doc_id {id_type}, key binary, h array<bigint>, times array<bigint>"
    every = cut(long_enough.select("doc_id", "key", "text").mapInArrow(find_anchors, schema), "anchors")
    texts = every.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"), F.first("times").alias("times")
    )
    texts = cut(texts, "texts")
    # One row per text and anchor string, however often the text repeats it.
    single = texts.select("key", F.explode(F.arrays_zip("h", "times")).alias("a")).select("key", "a.h", "a.times")
    repeated = single.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    wanted = single.select("key", "h").join(repeated, "h").groupBy("key").agg(F.collect_list(F.struct("h", "hot")).alias("found"))
    wanted = wanted.join(texts.select("key", "doc_id", "copies"), "key")

    def share_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                places = anchors(texts, length, gram)
                found = [sorted(_shared_blocks(t, f, *p, length, gram)) for t, f, p in zip(texts, part.column("found").to_pylist(), places)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "parts"])

    def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rank = TaskContext.get().partitionId(), 0
        met: dict[bytes, int] = {}  # single windows: 1 sent, 2 sent as repeated
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            for part, texts in blocks(batch, size=1 << 20):
                columns = [part.column(c).to_pylist() for c in ("key", "copies", "found", "hot_parts")]
                seen = _contexts(texts, *columns, length, gram)
                rows = []
                for block, after, before, single in sorted(seen):
                    held = seen[block, after, before, single]
                    key, pos, copies = held[0]
                    weight = 1 if len(held) == 1 and copies == 1 else 2
                    times = 0
                    if single:
                        name = xxhash.xxh3_128_digest(before + after, seed=len(before))
                        times = met.get(name, 0)
                        weight = 2 if times else weight
                        if len(met) >= MET:
                            met.clear()
                        met[name] = weight
                    own = key if weight == 1 else None
                    if times < 2:
                        rows.append((block, shard, rank, before, after, weight, own, pos, None))
                        rank += 1
                    if weight == 2:
                        rows += [
                            (xxhash.xxh64_intdigest(k, p) - (1 << 63), shard, 0, None, None, 0, k, p - len(before), p + len(after))
                            for k, p, n in held
                            if n == 1
                        ]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(arrays, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []

        def merged(rows):
            if not rows:
                return
            block, before, after, weight, key, pos, _ = zip(*rows)
            block = np.array(block, np.int64)
            numbers = np.cumsum(np.r_[0, block[1:] != block[:-1]])
            for found, first, last in repeated_windows(numbers, before, after, np.array(weight), length):
                own = [(key[r], pos[r] - b, pos[r] - a + length) for r, a, b in zip(found.tolist(), first.tolist(), last.tolist())]
                own = [x for x in own if x[0] is not None]
                yield spans(own)

        def spans(rows):
            columns = list(zip(*rows)) or [(), (), ()]
            types = (pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "start", "stop"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "before", "after", "weight", "key", "pos", "stop")]
            rows = list(zip(*columns))
            yield spans([(r[4], r[5], r[6]) for r in rows if r[3] == 0])
            for row in rows:
                if row[3]:
                    if len(pending) >= MERGED and pending[-1][0] != row[0]:
                        yield from merged(pending)
                        pending = []
                    pending.append(row)
        yield from merged(pending)

    rows = keyed.select("key", "doc_id", "text")
    # The parts of hot anchors whose shared bytes stand in many texts.
    wanted = cut(wanted, "wanted")
    split = cut(wanted.where(F.exists("found", lambda a: a["hot"])), "split")
    same_row = (rows["key"] == split["key"]) & rows["doc_id"].eqNullSafe(split["doc_id"])
    parts = rows.join(split, same_row).select(rows["key"], rows["text"], "found").mapInArrow(share_parts, "key binary, parts array<bigint>")
    parts = cut(parts.select("key", F.explode("parts").alias("part")), "parts").distinct()
    hot = parts.groupBy("part").count().where(F.col("count") > HOT).select("part")
    hot = cut(parts.join(hot, "part").groupBy("key").agg(F.collect_list("part").alias("hot_parts")), "hot-parts")
    wanted = wanted.join(hot, "key", "left")
    same_row = (rows["key"] == wanted["key"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    contexts = rows.join(wanted, same_row).select(rows["key"], rows["text"], "copies", "found", "hot_parts").mapInArrow(cut_contexts, CONTEXT)
    merged = contexts.repartition("block").sortWithinPartitions("block", "shard", "rank").mapInArrow(
        merge, "key binary, start long, stop long"
    )
    spans = merged.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    unique = texts.where("copies = 1").select("key", "doc_id").join(spans, "key")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit((1 << 62)).cast("long").alias("stop"))).alias("spans")
    copied = texts.where("copies > 1").select("key")
    copies = every.select("key", "doc_id").join(copied, "key").distinct().select("key", "doc_id", whole)
    return rows, unique.unionByName(copies)


def united(starts: list[int], stops: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by spans, within a text of a size."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = True
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row."""
    rows, found = find_spans(id_and_text(docs, id_col, text_col), length, gram)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                out = []
                for text, spans in zip(texts, part.column("spans").to_pylist()):
                    spans = spans or []
                    runs = united([s["start"] for s in spans], [s["stop"] for s in spans], len(text))
                    at, kept = 0, []
                    for a, b in runs:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    row = (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept) if with_kept else row)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if with_kept else ""
    names = [c.split()[0] for c in schema.split(", ")]
    same_row = (rows["key"] == found["key"]) & rows["doc_id"].eqNullSafe(found["doc_id"])
    joined = rows.join(found, same_row, "left").select(rows["doc_id"], rows["text"], "spans")
    return joined.mapInArrow(remove, schema)
