"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import search
from tests.llm.conftest import awkward_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=10):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, w in held:
            tf, score = Counter(w), 0
            m = 10 + 90 * len(w) * n_docs // max(1, n_terms)
            for t in wanted & set(tf):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:top])]
    return sorted(map(repr, out))


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in df.collect())


ITEMS = [(1, prose(1, 40)), (2, "AB ab other, TEXT x!"), (3, None), (4, ""), (5, "nothinglikeit"), (None, prose(2, 30)), (2, prose(3, 9))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("shard_postings", [1, 1_000_000])
def test_awkward_rows(awkward, items, empty_docs, shard_postings):
    expected = plain_search([(i, t) for i, t, *_ in awkward_rows()], ITEMS)
    assert rows_of(search.ranked_search(awkward, items, shard_postings=shard_postings)) == expected
    assert search.ranked_search(empty_docs, items).count() == 0
    assert search.ranked_search(awkward, items.limit(0)).count() == 0


def test_blocks_of_items(awkward, items):
    expected = plain_search([(i, t) for i, t, *_ in awkward_rows()], ITEMS)
    assert rows_of(search.ranked_search(awkward, items, block_terms=5)) == expected


@pytest.mark.parametrize("leaf", [1, 60, 4096])
def test_ties_copies_and_common_words(spark, monkeypatch, leaf):
    """Many equal scores, frequent words, and groups of copies, with intervals split down to single documents."""
    monkeypatch.setattr(search, "LEAF", leaf)
    rng = random.Random(leaf)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    texts += [texts[0]] * 40 + ["the the", "w1 w2"] * 20
    rng.shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    asked = [(k, " ".join(rng.choices(words, k=12))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = search.ranked_search(docs, spark.createDataFrame(asked, "item_id long, text string"), top=7, shard_postings=500)
    assert rows_of(found) == plain_search(rows, asked, 7)


def test_range_maxima_are_right():
    rng = np.random.default_rng(2)
    vocabulary = {b"a": 0, b"b": 1, b"c": 2}
    builder = search.ShardBuilder(vocabulary)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"z"], rng.integers(0, 12))) for _ in range(300)]
    builder.add(list(range(300)), texts)
    shard = search.Shard(builder.row().to_pylist()[0], search.Corpus(300, 1500, np.array([5, 700, 30])))
    for _ in range(300):
        k = rng.integers(0, 3)
        low, high = np.sort(rng.integers(shard.starts[k], shard.stops[k] + 1, 2))
        if low < high:
            at = shard.largest(np.array([low]), np.array([high]))[0]
            assert low <= at < high and shard.impact[at] == shard.impact[low:high].max()


def test_bounds_spare_most_documents(spark):
    """A rare term of large impact ends the search before all documents are scored."""
    vocabulary = {b"common": 0, b"rare": 1}
    builder = search.ShardBuilder(vocabulary)
    builder.add(list(range(20_000)), [b"common rare" if i in (7, 9000) else b"common" for i in range(20_000)])
    shard = search.Shard(builder.row().to_pylist()[0], search.Corpus(20_000, 20_002, np.array([1, 9000])))
    asked = []
    bounded = shard.bounded
    shard.bounded = lambda low, high: asked.append(1) or bounded(low, high)
    assert [i for _, i in shard.search([0, 1], [], 2)] == [7, 9000]
    assert len(asked) < 50
