"""The covering of the rule list on tables of counts per grid cell."""

from sieveline.llm import rulelist

NAMES = list(rulelist.GRIDS)
COUNTS = ["grow_bad", "grow_good", "prune_bad", "prune_good"]
PLAIN = dict.fromkeys(NAMES, 1) | {"word_length": 4, "n_words": 4}


def table(spark, rows):
    """Rows of (cells that differ from those of plain texts, counts)."""
    values = [tuple({**PLAIN, **cells}[n] for n in NAMES) + counts for cells, counts in rows]
    return spark.createDataFrame(values, ", ".join(f"{n} int" for n in NAMES) + ", " + ", ".join(f"{c} long" for c in COUNTS))


def fits(rule, cells):
    at = {**PLAIN, **cells}
    return all((at[c.name] > c.cell) == c.above for c in rule)


def caught(rules, cells):
    return any(fits(r, cells) for r in rules)


#: Nine ways to be bad, one of them with four conditions.
KINDS = [{n: 8} for n in NAMES] + [{"n_words": 1}, {"symbol_share": 3, "upper_share": 3, "exclaim_share": 3, "repeat_share": 3}]
NEAR_KINDS = [{n: 3 for n in KINDS[-1] if n != left} for left in KINDS[-1]]


def test_rules_are_not_capped(spark):
    rows = [({}, (0, 900, 0, 400))] + [(k, (20 + i, 0, 9, 0)) for i, k in enumerate(KINDS)] + [(k, (0, 40, 0, 20)) for k in NEAR_KINDS]
    rules = rulelist.learn(table(spark, rows))
    assert len(rules) >= len(KINDS) and max(map(len, rules)) >= 4
    assert all(caught(rules, k) for k in KINDS) and not any(caught(rules, k) for k in [{}, *NEAR_KINDS])


def test_imprecise_rules_are_passed_over(spark):
    """The strongest kinds of the growing set turn out good on the pruning set; the others are learned all the same."""
    wrong, right = KINDS[:3], KINDS[3:6]
    rows = [({}, (0, 900, 0, 400))] + [(k, (200, 0, 0, 80)) for k in wrong] + [(k, (20, 0, 9, 0)) for k in right]
    rules = rulelist.learn(table(spark, rows))
    assert all(caught(rules, k) for k in right) and not any(caught(rules, k) for k in [{}, *wrong])
    assert rulelist.learn(table(spark, rows), patience=1) == []


def test_labels_without_a_reason_end_the_learning(spark):
    rows = [({"symbol_share": i, "upper_share": j}, (10 + (i * j) % 5, 10, 5, 5)) for i in range(8) for j in range(8)]
    assert rulelist.learn(table(spark, rows)) == []
    assert rulelist.learn(table(spark, [])) == [] and rulelist.learn(table(spark, [({}, (50, 0, 20, 0))])) == []


def test_the_first_rule_decides(spark):
    edge = lambda name, cell: [rulelist.Condition(name, cell, True)]
    rules = [edge("symbol_share", 3), edge("exclaim_share", 3), edge("symbol_share", 0)]
    stats = "n_words long, word_chars long, n_symbols long, n_exclaim long"
    df = spark.createDataFrame([(10, 100, 50, 10), (10, 100, 1, 10), (10, 100, 1, 0), (10, 100, 0, 0)], stats)
    found = [r[0] for r in df.select(rulelist.first_rule(rules)).collect()]
    assert found == ["symbol_share >= 0.03", "exclaim_share >= 0.03", "symbol_share >= 0.005", None]
    assert df.select(rulelist.first_rule([]).alias("rule")).where("rule is not null").count() == 0
