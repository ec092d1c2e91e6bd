"""Join helpers for keys that one value may dominate."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that the sketch of frequent keys tracks for each partition of a join, and the most it may track.
TRACKED, MOST_TRACKED = 32, 1_000_000


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_tables(df: DataFrame, keys: list[str], partitions: int | None = None) -> dict[str, DataFrame]:
    """For each key column a small table ``key, _salts`` of the values that fill more than an average partition.

    All keys are counted in one pass by mergeable sketches of frequent items, which are bounded whatever
    the data look like; only they and one count leave the tasks. ``_salts`` is the number of average
    partitions that a value fills. There are fewer such values than partitions. The sketch is never above
    the true count and may be below it by a small share of all rows, so it can miss a value that is
    hardly hot, which then joins as it is. The tables are found once and hold for every join on the keys.
    """
    parts = partitions or partitions_of(df)
    tracked = min(MOST_TRACKED, TRACKED * parts)
    top = [f"approx_top_k(`{k}`, {min(parts, tracked)}, {tracked}) filter (where `{k}` is not null) as `{k}`" for k in keys]
    counts = [f"count(`{k}`) as `{k}`" for k in keys]
    found = df.select(*keys).selectExpr(f"struct({', '.join(top)}) as top", f"struct({', '.join(counts)}) as n").first()
    tables = {}
    for k in keys:
        fair = max(1, math.ceil((found["n"][k] or 0) / parts))
        hot = [(x["item"], math.ceil(x["count"] / fair)) for x in found["top"][k] or [] if x["count"] > fair]
        entry = lambda v, n: F.struct(F.lit(v).cast(df.schema[k].dataType).alias(k), F.lit(n).alias("_salts"))  # noqa: B023,E731
        # A table of literals: the optimizer sees at once that it is small, or that it is empty and needs no join.
        rows = [entry(v, n) for v, n in hot] or [entry(None, 1)]
        tables[k] = df.sparkSession.range(1).select(F.inline(F.array(*rows))).where(F.lit(bool(hot)))
    return tables


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``key, _salts`` for the values of one key that fill more than an average partition."""
    return hot_tables(df, [key], partitions)[key]


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: str | None = None,
    counts_from: DataFrame | None = None,
    partitions: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join where some keys of the left side may hold most of its rows.

    Rows of a hot key are spread, by the hash of ``spread_by``, over as many pieces as the key
    fills average partitions, and the matching right rows are copied once per piece; other keys
    join as they are. Rows with a null key match nothing and are spread over all partitions. The
    plan is the same at every size; the table of hot keys has fewer rows than there are
    partitions and is therefore broadcast. ``hot`` is that table, if ``hot_tables`` has found it for
    several joins at once; otherwise the keys are counted here, on ``counts_from`` if that names a
    narrower table with the same keys.
    """
    parts = partitions or partitions_of(left)
    hot = F.broadcast(hot_keys(left if counts_from is None else counts_from, key, parts) if hot is None else hot)
    at = F.xxhash64(F.col(spread_by or left.columns[0]))
    pieces = F.when(F.col(key).isNull(), F.lit(parts)).otherwise(F.coalesce("_salts", F.lit(1)))
    spread = left.join(hot, key, "left").withColumn("_salt", F.pmod(at, pieces).cast("int")).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return spread.join(copied, [key, "_salt"], how).drop("_salt")
