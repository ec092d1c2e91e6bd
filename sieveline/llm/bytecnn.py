"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the UTF-8 bytes in steps of ``STEP``, so that overlapping chunks
cover the whole document; the last chunk is filled with zero bytes, which have no weight. Each
filter's largest value over all chunks is kept, and a small dense layer combines them into one
probability. A byte is a short vector and a filter weighs these vectors by place, so that what is
learned of a byte at one place holds at all; for scoring both are multiplied out to a table of weights
by (place, byte), so a chunk costs ``WIDTH`` look-ups.

Learning: at most ``max_rows`` labelled rows, the first by a hash of their id and text, are fetched to
the driver, of longer texts a window of ``max_bytes`` characters at a place chosen by that hash
(scoring has no bound), and fitted by Adam on the cross-entropy of the quality label, both classes
weighing the same. So that maxima over many chunks mean the same as over few, a part of the examples
are several texts joined into one, which is good if all its parts are; and so that no place is special,
texts are shifted by some bytes. Since pooling passes a gradient to one chunk per filter, a step back
costs next to nothing. Everything is seeded, so a fit repeats.

Null and empty texts are one chunk of zero bytes. Rows of either one class or none give a constant
model. Labels that are null, or whose rows are repeated with both values, take no part (null) or part
with each value (repeated).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import blocks, extended, id_and_text

WIDTH, STEP, FILTERS, HIDDEN = 16, 8, 24, 12
#: Numbers that stand for a byte.
VECTOR = 8
MAX_ROWS, MAX_BYTES = 3000, 20_000
EPOCHS, BATCH, RATE, DECAY = 14, 48, 0.01, 1e-3
#: Share of the examples that are joined texts, the texts of one, and its bytes at most.
JOINED, PARTS, JOINED_BYTES = 0.4, 8, 60_000
#: Rows of a lower score are of low quality.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def activations(self, steps: np.ndarray) -> np.ndarray:
        """Filter values of the chunk that starts at each step; the last step only ends a chunk."""
        n = len(steps) - 1
        acc = np.tile(self.bias, (n, 1))
        for k in range(WIDTH):
            ahead, place = divmod(k, STEP)
            acc += np.take(self.filters[k], steps[ahead : ahead + n, place], axis=0)
        return acc

    def head(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        steps, starts = lay_out(texts)
        return self.head(np.maximum.reduceat(self._masked(steps, starts), starts, axis=0)) if texts else np.empty(0)

    def _masked(self, steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        acc = self.activations(steps)
        acc[starts[1:] - 1] = -np.inf  # a filler step between two texts starts no chunk
        return acc


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of ``STEP``, a zero row after each text, and the first row of each text."""
    sizes = [max(1, -(-len(t) // STEP)) for t in texts]
    joined = b"".join([t.ljust((n + 1) * STEP, b"\0") for t, n in zip(texts, sizes)])
    starts = np.cumsum([0, *(n + 1 for n in sizes)])[:-1]
    return np.frombuffer(joined, np.uint8).reshape(-1, STEP), starts


def _examples(texts: list[bytes], labels: np.ndarray, chosen: np.ndarray, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """The chosen texts, shifted by some bytes, some with others joined to them."""
    out, marks = [], labels[chosen].copy()
    for k, i in enumerate(chosen.tolist()):
        parts = [i]
        if rng.random() < JOINED:
            # Good texts mostly, so that joined texts are not nearly all bad.
            more = rng.integers(0, len(texts), rng.integers(1, PARTS))
            parts += [j for j in more.tolist() if labels[j] == 1 or rng.random() < 0.1]
        text = b" " * int(rng.integers(0, STEP)) + texts[i]
        for j in parts[1:]:
            if len(text) + len(texts[j]) <= JOINED_BYTES:
                text = text + b" " + texts[j] if rng.random() < 0.5 else texts[j] + b" " + text
                marks[k] = min(marks[k], labels[j])
        out.append(text)
    return out, marks


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network fitted to labelled texts (labels 0 or 1)."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    vectors, places = normal(0.3, 256, VECTOR), normal(0.15, WIDTH, VECTOR, FILTERS)
    vectors[0] = 0
    bias, dense, dense_bias = np.zeros(FILTERS, np.float32), normal(0.3, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32)
    out, out_bias = normal(0.3, HIDDEN), np.zeros(1, np.float32)
    network = lambda: Network(np.matmul(vectors, places), bias, dense, dense_bias, out, out_bias)
    share = float(labels.mean()) if labels.size else 0.5
    if not labels.size or share in (0.0, 1.0):
        dense[:] = 0
        out_bias[:] = np.log((share + 0.01) / (1.01 - share))
        return network()
    weights = [vectors, places, bias, dense, dense_bias, out, out_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    n_steps = epochs * -(-len(texts) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), BATCH):
            step += 1
            some, marks = _examples(texts, labels, order[at : at + BATCH], rng)
            weigh = np.where(marks == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            d_table, *others = _gradients(network(), some, marks, weigh)
            d_vectors = np.einsum("kbf,kdf->bd", d_table, places)
            d_vectors[0] = 0
            gradients = [d_vectors, np.einsum("bd,kbf->kdf", vectors, d_table), *others]
            rate = RATE * (1 - step / (n_steps + 1))
            for w, g, (m, v) in zip(weights, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + DECAY * w)
    return network()


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weigh: np.ndarray) -> list[np.ndarray]:
    steps, starts = lay_out(texts)
    acc = net._masked(steps, starts)
    stops = np.r_[starts[1:], len(acc)]
    best = np.stack([a + acc[a:b].argmax(axis=0) for a, b in zip(starts, stops)])
    pooled = np.take_along_axis(acc, best, axis=0)
    hidden = np.maximum(pooled @ net.dense + net.dense_bias, 0)
    error = weigh * (net.head(pooled) - labels) / len(labels)
    d_hidden = np.outer(error, net.out) * (hidden > 0)
    d_pooled = (d_hidden @ net.dense.T).astype(np.float32)
    d_filters = np.zeros_like(net.filters)
    column = np.broadcast_to(np.arange(FILTERS), best.shape)
    for k in range(WIDTH):
        ahead, place = divmod(k, STEP)
        np.add.at(d_filters[k], (steps[best + ahead, place], column), d_pooled)
    return [
        d_filters, d_pooled.sum(0), (pooled.T @ d_hidden).astype(np.float32), d_hidden.sum(0).astype(np.float32),
        (hidden.T @ error).astype(np.float32), np.array([error.sum()], np.float32),
    ]


def held_out(id_col):
    """True for the rows that no fit may see."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> Network:
    """The network learned from a bounded sample of the labelled rows that are not held out."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    texts = id_and_text(docs, id_col, text_col).where(F.col("text").isNotNull())
    # Ids and hashes of texts are enough to choose the rows; rows with an equal id stand apart by their text.
    chosen = texts.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id").distinct()
    first = chosen.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h", "y").limit(max_rows)
    place = F.pmod(F.xxhash64("doc_id", "h"), F.greatest(F.lit(1), F.length("text") - max_bytes + 1)) + 1
    window = F.when(F.length("text") > max_bytes, F.col("text").substr(place.cast("int"), F.lit(max_bytes))).otherwise(F.col("text"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(first), ["doc_id", "h"])  # max_rows numbers at most
    rows = rows.groupBy("doc_id", "h", "y").agg(F.first(F.encode(window, "UTF-8")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["y"], bytes(r["text"])))
    return fit([bytes(r["text"]) for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score", keep: float | None = None) -> DataFrame:
    """The rows with their probability in ``out``, in place of a column of that name; with ``keep``, instead the unchanged rows of at least that."""
    docs = docs if keep is not None else docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text_col, 1 << 20):
                found = shared.value.score(texts).astype(np.float64)
                if keep is not None:
                    yield part.filter(pa.array(found >= keep))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, out])

    return docs.mapInArrow(run, docs.schema if keep is not None else extended(docs.schema, **{out: T.DoubleType()}))
