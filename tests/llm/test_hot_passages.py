"""A passage that stands in many documents with different surroundings."""

from collections import Counter

from sieveline.llm import substrings
from tests.llm.conftest import prose
from tests.llm.test_operators import REMOVED, repeated_of

PASSAGE = prose(5, 90)[:550]


def passage_texts(n):
    return [prose(100 + k, 70) + PASSAGE + prose(900 + k, 70) for k in range(n)]


def test_no_block_gathers_the_passage():
    """With hot parts split again, a block gets one context instead of one per document."""
    data = [t.encode() for t in passage_texts(50)]
    places = substrings.anchors(data)
    count = Counter(h for _, hashes in places for h in set(hashes.tolist()))
    found = [[{"h": h, "hot": True} for h in set(hashes.tolist()) if count[h] > 1] for _, hashes in places]
    parts = [substrings._shared_blocks(t, f, *p, substrings.LENGTH, substrings.GRAM) for t, f, p in zip(data, found, places)]
    often = Counter(p for some in parts for p in some)
    assert max(often.values()) == 50
    hot = [[p for p in some if often[p] > 5] for some in parts]
    seen = substrings._contexts(data, range(50), [1] * 50, found, hot, substrings.LENGTH, substrings.GRAM)
    assert max(Counter(block for block, *_ in seen).values()) <= 5
    assert max(map(len, seen.values())) == 50


def test_result_with_hot_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 5)
    texts = passage_texts(40) + [PASSAGE, PASSAGE[:450], PASSAGE[60:] + prose(7, 30), prose(8, 30) + PASSAGE[:420], PASSAGE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeated(docs).select(*REMOVED).collect()}
    assert [found[i] for i in range(len(texts))] == repeated_of(texts, 400)
