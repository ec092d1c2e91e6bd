"""Connected components of a link table by alternating star contraction.

Each round is made of joins and minima per node and its result is written to the shared folder, so
no lineage grows and nothing but two numbers a round comes to the driver. Rounds grow with the
logarithm of the component size.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    passed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return passed.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for each node of the links (u, v), u > v, but the roots themselves."""
    state = cut(edges.select("u", "v"), "links")
    before = None
    while True:
        state = cut(_small_star(_large_star(state)), "stars")
        hashed = F.xxhash64("u", "v")
        now = state.agg(F.count(F.lit(1)), F.sum(hashed % 1000003), F.sum(hashed % 998244353)).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
