"""Mixing sources to target weights, in DataFrame operations alone.

Sources share the words of the corpus by weight; a source gives at most ``max_epochs`` times its own
words and what it cannot give is shared again by weight. The final shares have a closed form: with
the sources in order of cap over weight, the level at which all words are dealt is the largest of
(words left) / (weights left) taken before each source, and a source gets the lesser of its cap and
its weight times the level.

Within a source, documents are ordered by a hash of their id. The order is cut into ranges of the
hash, so that no source, however large, lies in one task: ranges are summed, the sums of the ranges
before give each range its base, and a running sum inside the range gives each document its place.
A source takes whole epochs of all its documents and then the documents from the start of the order
up to the rest of its budget.

Texts that are null or without words have size 0 and take nothing. A null source is a source, the
last. Rows with an equal id stand together in the order, by size (by a hash of all columns where whole
documents are taken); a row without an id is placed by its text. Tables with one row per source, or per source and range, are the only small ones; the single
ordered pass over all rows of a table is over the sources.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that a hash range holds on average, if there are enough.
RANGE_ROWS = 50_000
LEAST_RANGES = 64
KEY = ["_null", "_source"]


def hash_key(id_col: Column, text_col: Column, seed: str) -> Column:
    text = F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), text)).cast("binary"))


def _source_key(source: Column) -> list[Column]:
    return [source.isNull().alias("_null"), F.coalesce(source, F.lit("")).alias("_source")]


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, tie: Column | None = None) -> DataFrame:
    """doc_id, source key, size in words, hash of every row, and what orders equal hashes."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *_source_key(F.col(source_col)),
        words.alias("size"),
        hash_key(F.col(id_col), F.col(text_col), seed).alias("_hash"),
        (words if tie is None else tie).alias("_tie"),
    )


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, whole epochs, and words of the last, partial epoch."""
    sources = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(*KEY))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights))
    weighed = sources.select("*", place.alias("_place"), weight.alias("_weight"))
    cap = F.col("source_size") * max_epochs
    fill = Window.orderBy(cap / F.col("_weight"), "_place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    leveled = weighed.withColumn("_level", left / weights_left)
    target = F.least(cap.cast("double"), F.max("_level").over(everything) * F.col("_weight"))
    shared = leveled.select(*KEY, "source_size", target.alias("target"))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    return shared.withColumn("_epochs", epochs).withColumn("_rest", words - F.col("_epochs") * F.col("source_size"))


def placed(sizes: DataFrame, ranges: int) -> DataFrame:
    """The rows with ``_before``: the words of their source that stand before them in hash order."""
    part = F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int")
    rows = sizes.withColumn("_range", part)
    sums = rows.groupBy(*KEY, "_range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy(*KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*KEY, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*KEY, "_range").orderBy("_hash", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(bases, [*KEY, "_range"]).withColumn("_before", F.col("_base") + F.col("_local"))


def _ranges(sizes: DataFrame) -> int:
    return max(LEAST_RANGES, sizes.count() // RANGE_ROWS)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix:",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row.

    The last document of a budget is taken in part, so a source's words are its rounded target.
    """
    sizes = cut(sized(docs, id_col, text_col, source_col, seed), "mix")
    rows = placed(sizes, _ranges(sizes)).join(budgets(sizes, weights, max_epochs), KEY)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_epochs") + last).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix:",
) -> DataFrame:
    """The rows that the mix takes, whole and repeated as often as it takes them, with all columns.

    The last document of a budget is taken if at least half of it is within the budget. The rows
    taken once more are those up to one hash per source (and up to one hash of the whole row among equal
    ones), so texts meet a table of the sources only. Rows that are equal in all columns are taken alike.
    """
    every = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    sizes = cut(sized(docs, id_col, text_col, source_col, seed, every), "mix")
    plan = budgets(sizes, weights, max_epochs)
    within = (F.col("_rest") - F.col("_before")) * 2 >= F.col("size")
    rows = placed(sizes, _ranges(sizes)).join(plan.select(*KEY, "_rest"), KEY)
    last = rows.where((F.col("_rest") > 0) & within).groupBy(*KEY).agg(F.max(F.struct("_hash", "_tie")).alias("_last"))
    plan = cut(plan.join(last, KEY, "left").select(*KEY, "_epochs", "_last"), "mix-plan")
    # The row is packed, so none of its names can clash.
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        *_source_key(F.col(source_col)),
        F.struct(hash_key(F.col(id_col), F.col(text_col), seed).alias("_hash"), every.alias("_tie")).alias("_at"),
    ).join(plan, KEY)
    once_more = F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False)).cast("int")
    repeated = packed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), (F.col("_epochs") + once_more).cast("int"))))
    return repeated.select("_row.*")
