"""Periodic runs against a comparison of all words at all distances."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sieveline.llm import runs
from tests.llm.conftest import awkward_rows


def plain_runs(words, least=12):
    """Maximal stretches in which words a period apart are equal, each with its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def plain_row(words):
    found = plain_runs(words)
    best = min(((-n, s, q) for s, n, q in found), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def periodic_texts(seed, count):
    """Texts over few letters, many with a planted period at a random place."""
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 30])
        text = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 24)
            text = [text[a + (i - a) % p] if i >= a and a + (i - a) % p < n else text[i] for i in range(n)]
        yield text


@pytest.mark.parametrize("least", [4, 12])
def test_runs_equal_brute_force(least):
    texts = list(periodic_texts(least, 600))
    found = runs.runs_of_texts(texts, least)
    assert found == [plain_runs(t, least) for t in texts]
    assert sum(map(len, found)) > 100


def test_runs_with_several_periods_and_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    nested = [*([b"x", b"y"] * 7 + [b"z"]) * 5, *[b"w"] * 30]
    assert runs.runs_of_texts([b, nested]) == [plain_runs(b), plain_runs(nested)]
    assert len(plain_runs(b)) > 20


def test_long_text_of_one_word_and_of_a_long_period():
    rng = np.random.default_rng(1)
    base = [str(x).encode() for x in rng.integers(0, 50_000, 30_000)]
    assert runs.runs_of_texts([[b"w"] * 50_000, base + base]) == [[(0, 50_000, 1)], [(0, 60_000, 30_000)]]


def test_answers_do_not_mix_documents():
    half = [b"p", b"q", b"r"] * 3
    assert runs.runs_of_texts([half, half, half]) == [[], [], []]


def test_query_on_awkward_rows(awkward, empty_docs):
    found = runs.run_digests(runs.periodic_runs(runs.with_planted_runs(awkward)))
    expected = [(i, *plain_row(planted(i, (t or "").encode().split()) and [w.decode() for w in planted(i, (t or "").encode().split())])) for i, t, *_ in awkward_rows() if len(t or "") < 20_000]
    long = {i for i, t, *_ in awkward_rows() if len(t or "") >= 20_000}
    assert sorted(map(repr, (tuple(r) for r in found.collect() if r["doc_id"] not in long))) == sorted(map(repr, expected))
    assert found.count() == len(awkward_rows())
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_runs(empty_docs))).count() == 0


def test_query_on_planted_documents(spark):
    rng = random.Random(3)
    rows = [(i, " \n".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 120)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = runs.run_digests(runs.periodic_runs(runs.with_planted_runs(df))).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: plain_row(planted(i, t.split())) for i, t in rows}
    assert sum(r["n_runs"] > 0 for r in found) > 15
