"""Quality rules: a learned decision list over text statistics, in DataFrame operations alone.

Base rules fail texts with few words or with mostly repeated three-word windows. What passes them
goes through learned rules, each a conjunction of thresholds such as ``symbol_share >= 0.05 and
n_words < 800``. They are learned by sequential covering: a rule grows by the condition of the best
information gain until it covers no good text of the growing set, loses its last conditions as long
as that helps on the pruning set, and is kept if it is precise there. Kept or not, the texts it
covers are taken away and the next rule is grown, until no condition tells the bad texts that are left
from good ones, or ``patience`` rules in a row were not precise (what is left is then noise that no
threshold can tell). Neither the rules nor the conditions of a rule are bounded in number. The result is
an ordered conditional expression.

Thresholds come from fixed grids, so all labelled rows take part as counts per combination of grid
cells, and every step is one aggregate that returns two sums per threshold. Rows that are held out
(crc32 of the id, modulo 5, is 0), labels that are null, and texts that fail the base rules do not
take part. Without any bad text no rule is learned.

Null and empty texts have no words and fail the base rules. Repeated rows count each time.
Windows of one text are told apart by 64-bit hashes of their words. Other columns are ignored.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.binding import let
from sieveline.llm.common import cut, id_and_text

SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)
GRIDS = {
    "symbol_share": SHARES,
    "upper_share": SHARES,
    "exclaim_share": SHARES,
    "repeat_share": SHARES,
    "dup_line_share": SHARES,
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 16.0),
    "n_words": (75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 800.0, 1500.0, 3000.0, 6000.0),
}
#: Bad texts that a condition covers at least in the growing set, and the precision asked for on the pruning set.
LEAST_BAD, LEAST_PRECISION = 5, 0.9
#: Imprecise rules in a row that end the learning.
PATIENCE = 5
SPACE = r"[\x20\x09-\x0D]+"


def _covered(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, from an array of words."""

    def windows(words):
        places = F.sequence(F.lit(0), F.size(words) - 3)
        hashed = lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        )
        return F.sort_array(F.transform(places, hashed))

    def starts(s):
        at = lambda j: F.get(s, j)["h"]
        same_at = lambda x, j: F.when(
            F.coalesce(x["h"] == at(j - 1), F.lit(False)) | F.coalesce(x["h"] == at(j + 1), F.lit(False)), x["i"]
        )
        return F.sort_array(F.filter(F.transform(s, same_at), lambda i: i.isNotNull()))

    def words_in(p):
        # Each start covers up to the next start, three words at most.
        gap = lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))
        return F.aggregate(F.transform(p, gap), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(w) > 3, let(let(windows(w), starts), words_in)).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts of each text: words, their characters, symbols, repeated lines and words, and more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    )
    counted = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("x"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_exclaim"),
    )
    return counted.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", F.col("x.n_dup_lines").cast("long").alias("n_dup_lines"),
        "w.n_repeat_words", F.col("x.n_lines").cast("long").alias("n_lines"), "n_upper", "n_exclaim",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def feature(name: str) -> Column:
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }[name]


@dataclass(frozen=True)
class Condition:
    """``name >= grid[cell]`` if ``above``, else ``name < grid[cell]``."""

    name: str
    cell: int
    above: bool

    def on_cells(self) -> Column:
        return F.col(self.name) > self.cell if self.above else F.col(self.name) <= self.cell

    def on_values(self) -> Column:
        edge = F.lit(GRIDS[self.name][self.cell])
        return feature(self.name) >= edge if self.above else feature(self.name) < edge

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {GRIDS[self.name][self.cell]:g}"


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def labelled_cells(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Counts of good and bad texts, of the growing and the pruning set, per combination of grid cells."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    fold = F.crc32(F.col("doc_id").cast("string"))
    rows = stats.join(marks, "doc_id").where(~base_failed() & (fold % 5 != 0))
    cells = [sum((feature(n) >= t).cast("int") for t in grid).alias(n) for n, grid in GRIDS.items()]
    pruning = F.floor(fold / 5) % 3 == 0
    rows = rows.select(*cells, (F.col("y") == 0).alias("_bad"), pruning.alias("_pruning"))
    count = lambda bad, late: F.sum(((F.col("_bad") == bad) & (F.col("_pruning") == late)).cast("long"))
    return rows.groupBy(*GRIDS).agg(
        count(True, False).alias("grow_bad"), count(False, False).alias("grow_good"),
        count(True, True).alias("prune_bad"), count(False, True).alias("prune_good"),
    )


def _best_condition(rows: DataFrame) -> tuple[Condition | None, int]:
    """The condition of the best information gain on the growing set, and the good texts it leaves."""
    sums = [F.sum("grow_bad"), F.sum("grow_good")]
    for name, grid in GRIDS.items():
        for cell in range(len(grid)):
            above = F.col(name) > cell
            sums += [F.sum(F.when(above, F.col("grow_bad"))), F.sum(F.when(above, F.col("grow_good")))]
    values = [v or 0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    bad, good = values[:2]
    best, gain, left, at = None, 0.0, good, 2
    if not bad:
        return None, good
    for name, grid in GRIDS.items():
        for cell in range(len(grid)):
            b, g = values[at : at + 2]
            at += 2
            for above, p, n in ((True, b, g), (False, bad - b, good - g)):
                if p >= LEAST_BAD:
                    value = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                    if value > gain + 1e-9:
                        best, gain, left = Condition(name, cell, above), value, n
    return best, left


def _pruned(rows: DataFrame, grown: list[Condition]) -> tuple[list[Condition], float, int]:
    """The shortest prefix of the conditions that is best on the pruning set, its precision and bad texts."""
    sums = []
    for k in range(1, len(grown) + 1):
        hit = _all([c.on_cells() for c in grown[:k]])
        sums += [F.sum(F.when(hit, F.col("prune_bad"))), F.sum(F.when(hit, F.col("prune_good")))]
    values = [v or 0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    worth = [(values[2 * k] - values[2 * k + 1]) / max(1, values[2 * k] + values[2 * k + 1]) for k in range(len(grown))]
    k = max(range(len(grown)), key=lambda i: (worth[i], -i))
    return grown[: k + 1], values[2 * k] / max(1, values[2 * k] + values[2 * k + 1]), values[2 * k]


def learn(cells: DataFrame, patience: int = PATIENCE) -> list[list[Condition]]:
    """The rules for bad texts, in order.

    Ends for certain: a condition has to raise the precision, and a rule takes at least ``LEAST_BAD``
    bad texts of the growing set with it.
    """
    rules: list[list[Condition]] = []
    rows, misses = cells, 0
    while misses < patience:
        grown: list[Condition] = []
        left = 1
        while left:
            condition, left = _best_condition(rows.where(_all([c.on_cells() for c in grown])))
            if condition is None:
                break
            grown.append(condition)
        if not grown:
            break
        rule, precision, bad = _pruned(rows, grown)
        if precision >= LEAST_PRECISION and bad:
            rules.append(rule)
            misses = 0
        else:
            misses += 1
        rows = rows.where(~_all([c.on_cells() for c in rule]))
    return rules


def first_rule(rules: list[list[Condition]]) -> Column:
    """The text of the first rule that fits a row of statistics, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        out = out.when(_all([c.on_values() for c in rule]), F.lit(" and ".join(map(str, rule))))
    return out


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    patience: int = PATIENCE,
) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the learned rule that fits, else null) and kept of every row."""
    stats = cut(statistics(docs, id_col, text_col), "statistics")
    rules = learn(cut(labelled_cells(stats, labels, id_col, label_col), "cells"), patience)
    judged = stats.select("*", base_failed().alias("base_failed"), first_rule(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
