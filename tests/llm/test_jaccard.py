"""The Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest

from sieveline.llm import jaccard
from sieveline.llm.queries import table
from tests.llm.conftest import awkward_rows, prose


def shingles_of(text, k=5):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return frozenset(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_join(rows, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and group[i] != group[j] and 100 * len(a & b) >= percent * len(a | b) and b:
                group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    return sorted(repr((i, len(s), least[g])) for (i, _), s, g in zip(rows, sets, group))


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(repr(tuple(r)) for r in df.collect())


def test_awkward_rows(awkward, empty_docs):
    expected = plain_join([(i, t) for i, t, *_ in awkward_rows()])
    assert rows_of(jaccard.jaccard_components(awkward)) == expected
    assert rows_of(jaccard.jaccard_components(awkward.repartition(1))) == expected
    assert jaccard.jaccard_components(empty_docs).count() == 0


def test_given_documents(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(jaccard.jaccard_components(docs)) == plain_join(rows)


def edited(base, edits, rng):
    w = list(base)
    for at in rng.sample(range(len(w)), edits):
        w[at] = "x" + str(rng.random())
    return " ".join(w)


@pytest.mark.parametrize("cell", [jaccard.CELL_SHINGLES, 900])
def test_groups_of_near_copies(spark, monkeypatch, cell):
    """Pairs, a large group, copies just below the similarity, a shared passage; in one cell and in many."""
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", cell)
    monkeypatch.setattr(jaccard.cells, "__defaults__", (cell,))
    rng, texts = random.Random(cell), []
    for n in range(40):
        base = prose(1000 + n, 60).split()
        texts += [edited(base, rng.randint(0, 3), rng) for _ in range(2)]
    large = prose(1, 100).split()
    texts += [edited(large, rng.randint(0, 2), rng) for _ in range(60)]
    texts += [edited(large[:80], 4, rng) for _ in range(30)]
    passage = prose(2, 40)
    texts += [passage + " " + prose(3000 + n, 25) for n in range(50)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_join(rows)
    assert rows_of(jaccard.jaccard_components(docs)) == expected
    assert len({e.split(", ")[2] for e in expected}) < len(rows) - 40


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("heaped", [0, 1 << 30])
def test_search_finds_all_pairs(monkeypatch, percent, heaped):
    """DivideSkip with both ways of merging, on sets with rare, common and very common elements."""
    monkeypatch.setattr(jaccard, "HEAPED", heaped)
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(40):
        base = np.unique(np.r_[rng.integers(0, 30, 20), rng.integers(100, 100_000, rng.integers(1, 60))])
        for _ in range(rng.integers(1, 5)):
            kept = base[rng.random(base.size) > rng.choice([0, 0.05, 0.2])]
            sets.append(np.unique(np.r_[kept, rng.integers(100, 100_000, rng.integers(0, 3))]))
    sets.sort(key=len)
    everything = lambda q, places: np.ones(places.size, bool)
    found = set(jaccard.search(sets, everything, percent))
    expected = set()
    for i, a in enumerate(sets):
        for j in range(i):
            common = np.intersect1d(a, sets[j]).size
            if 100 * common >= percent * (a.size + sets[j].size - common):
                expected.add((i, j))
    assert found == expected and len(expected) > 5


def test_bounds_hold_for_all_sizes():
    """What the narrowing relies on, for every two sizes that can link."""
    for percent in (50, 80, 95):
        for a in range(1, 400):
            assert jaccard.least_overlap(a, percent) >= jaccard.extra_of(jaccard.least_overlap(a, percent)) >= 1
            assert jaccard.prefix_length(a, percent) >= jaccard.rarest_length(a, percent) >= 1
            for b in range(jaccard.least_overlap(a, percent), a + 1):
                needed = jaccard.required_overlap(a, b, percent)
                assert needed >= jaccard.least_overlap(a, percent)
                assert 100 * needed >= percent * (a + b - needed) and 100 * (needed - 1) < percent * (a + b - needed + 1)


def test_a_dense_group_costs_links_in_proportion(spark):
    rng = random.Random(4)
    base = prose(5, 120).split()
    rows = [(k, edited(base, 1, rng)) for k in range(300)]
    sets = [(0, 0, k, len(s), s.view("int64").tolist()) for k, s in ((k, jaccard.shingles(t.encode())) for k, t in rows)]
    searched = spark.createDataFrame(sets, "cell long, side int, node long, n long, found array<long>")
    assert jaccard.links(searched, 80, 4).count() == 299
