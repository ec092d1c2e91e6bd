"""A benchmark beyond one broadcast block, on all awkward rows."""

from collections import Counter

from sieveline.llm import decontaminate
from tests.llm.conftest import awkward_rows
from tests.llm.test_operators import ITEMS, contamination_of


def test_blocks_keep_every_row(spark, awkward):
    """Rows with null or repeated ids stay apart, each with its own hits."""
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    expected = Counter((i, *contamination_of(t, ITEMS)) for i, t, *_ in awkward_rows())
    found = decontaminate.contamination(awkward, items, block_words=10)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == expected


def test_one_block_is_live(spark, awkward, monkeypatch):
    """Each block but the last is given back before the next one is sent, and the plan left scans once."""
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    context, events = type(spark.sparkContext), []
    plain = context.broadcast

    def broadcast(self, value):
        shared = plain(self, value)
        if isinstance(value, decontaminate.WindowSet):
            events.append("sent")
            destroy = shared.destroy
            shared.destroy = lambda *a: (events.append("given back"), destroy(*a))
        return shared

    monkeypatch.setattr(context, "broadcast", broadcast)
    for run in (decontaminate.contamination, decontaminate.clean):
        events.clear()
        found = run(awkward, items, block_words=10)
        n = events.count("sent")
        assert n > 2 and events == ["sent", "given back"] * (n - 1) + ["sent"]
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert found.count() > 0
        whole = run(awkward, items)
        assert Counter(map(str, found.collect())) == Counter(map(str, whole.collect()))
