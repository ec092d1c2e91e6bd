"""K-means, nearest-centroid assignment, cluster profiles and the silhouette."""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.blocks import BLOCK_ROWS, CELLS, matrix
from sieveline.operators.joins import partitions_of
from sieveline.session import shared_folder

# The standard number of clusters and seed.
N_CLUSTERS = 10
SEED = 42


def train_kmeans(
    df: DataFrame, n_clusters: int = N_CLUSTERS, seed: int = SEED, vector: str = "embedding"
) -> KMeansModel:
    features = df.select(array_to_vector(F.col(vector)).alias("features"))
    return KMeans(k=n_clusters, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(features)


def predict_clusters(model: KMeansModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``cluster_id`` from a fitted model; null where the row has no vector."""
    ready = df.withColumn("features", array_to_vector(F.col(vector)))
    known = model.transform(ready.filter(F.col(vector).isNotNull())).drop("features")
    unknown = df.filter(F.col(vector).isNull()).withColumn("cluster_id", F.lit(None).cast("int"))
    return known.unionByName(unknown)


def centroids_by(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, n, centroid``: one partial mean vector per group and task reaches the shuffle."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid"),
    )


cluster_profile = centroids_by


def collect_centroids(centroids: DataFrame, label: str) -> tuple[list, np.ndarray]:
    """Labels in order and their vectors: model parameters, one row per class or cluster."""
    rows = centroids.orderBy(label).select(label, "centroid").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype="float64")


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gaps = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(gaps, 0.0)


def assign_clusters(df: DataFrame, labels: list, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Nearest centroid of each row, ties to the earlier one; null where there is no vector."""
    ids = np.asarray(labels, dtype="int64")

    @F.arrow_udf("long")
    def nearest(v: pa.Array) -> pa.Array:
        out = pa.array([None] * len(v), type=pa.int64())
        known = v.is_valid()
        present = v.filter(known)
        if len(present) == 0:
            return out
        best = squared_distances(matrix(present), centers).argmin(axis=1)
        values = np.zeros(len(v), dtype="int64")
        mask = known.to_numpy(zero_copy_only=False)
        values[mask] = ids[best]
        return pa.array(values, mask=~mask)

    return df.withColumn("cluster_id", nearest(F.col(vector)))


class _Cell:
    """One cell of the grid: a group of points that is held, and one that streams past it.

    Each distance between the two is computed once and adds to the sums of both its points.
    """

    def __init__(self, diagonal: bool, k: int):
        self.diagonal, self.k = diagonal, k
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.ids = self.points = self.members = self.sums = None

    def hold(self, ids: pa.Array, points: np.ndarray, members: np.ndarray) -> None:
        self.parts.append((ids, points, members))

    def settle(self) -> bool:
        """True if there are held points, which are then one matrix."""
        if self.parts:
            self.ids = pa.concat_arrays([p[0] for p in self.parts])
            self.points = np.concatenate([p[1] for p in self.parts])
            self.members = np.concatenate([p[2] for p in self.parts])
            self.sums = np.zeros((len(self.points), self.k))
            self.parts = []
        return self.points is not None

    def meet(self, points: np.ndarray, members: np.ndarray) -> np.ndarray:
        """For each point, its summed distance to the held points of each cluster (points x k)."""
        sums = np.zeros((len(points), self.k))
        step = max(1, CELLS // len(self.points))
        for at in range(0, len(points), step):
            gaps = np.sqrt(squared_distances(points[at : at + step], self.points))
            sums[at : at + step] = gaps @ self.members
            if not self.diagonal:
                self.sums += gaps.T @ members[at : at + step]
        return sums

    def held_sums(self) -> tuple[pa.Array, np.ndarray]:
        return self.ids, self.meet(self.points, self.members) if self.diagonal else self.sums


def silhouette(
    df: DataFrame,
    n_clusters: int,
    cluster: str = "cluster_id",
    vector: str = "embedding",
    squared: bool = False,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """One row ``silhouette, n``: mean silhouette with Euclidean distance, exact.

    -1 when fewer than two clusters were asked for or found, or there are fewer rows than clusters.
    Equal vectors of a cluster are one point with a weight. The points are dealt into groups, and a
    task takes a pair of groups: it holds at most about ``block`` points and turns each distance to the
    points that stream past into sums per cluster for both. Pairs are never rows and each pair of
    groups meets once, but the work is quadratic. ``squared=True`` uses squared distance, which
    needs one pass.
    """
    spark = df.sparkSession
    doubles = F.col(vector).cast("array<double>").alias("_v")
    clean = df.filter(F.col(vector).isNotNull()).select(F.col(cluster).alias("_k"), doubles)
    points = clean.withColumn("_n", F.lit(1).cast("long")) if squared else _weighted_points(clean)
    found = points.groupBy("_k").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("points")).collect()
    sizes = {r["_k"]: r["n"] for r in found}
    total = sum(sizes.values())
    if n_clusters < 2 or total < n_clusters or len(sizes) < 2:
        return spark.createDataFrame([(-1.0, total)], "silhouette double, n long")
    if squared:
        ready = clean.select(array_to_vector("_v").alias("features"), F.col("_k").alias("prediction"))
        score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(ready)
        return spark.createDataFrame([(float(score), total)], "silhouette double, n long")

    names = sorted(sizes)
    counts = np.array([sizes[k] for k in names], dtype="float64")
    slot = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    indexed = points.withColumn("_k", F.element_at(slot, F.col("_k")))
    sums = _sums_on_grid(indexed, len(names), _groups(sum(r["points"] for r in found), block, partitions_of(df)))

    own = F.get(F.col("sums"), F.col("_k"))
    size = F.get(F.lit(counts.tolist()), F.col("_k"))
    means = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda i: F.when(i != F.col("_k"), F.get(F.col("sums"), i) / F.get(F.lit(counts.tolist()), i)),
    )
    scored = sums.select(
        "_n", size.alias("size"), (own / F.greatest(size - 1, F.lit(1.0))).alias("a"), F.array_min(means).alias("b")
    )
    wider = F.greatest("a", "b")
    each = F.when((F.col("size") <= 1) | (wider == 0), 0.0).otherwise((F.col("b") - F.col("a")) / wider)
    return scored.agg((F.sum(each * F.col("_n")) / F.sum("_n")).alias("silhouette"), F.sum("_n").alias("n"))


def _weighted_points(vectors: DataFrame) -> DataFrame:
    """``_k, _v, _n, _id``: the different vectors of each cluster, written once so that ids stay."""
    folder = shared_folder(vectors.sparkSession, "points")
    points = vectors.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_id", F.monotonically_increasing_id())
    points.write.parquet(folder)
    return vectors.sparkSession.read.schema(points.schema).parquet(folder)


def _groups(points: int, block: int, partitions: int) -> int:
    """Groups of about ``block`` points at most, and as many as give a partition one cell of the grid."""
    return max(1, -(-points // block), (math.isqrt(8 * partitions + 1) - 1) // 2)


def _sums_on_grid(points: DataFrame, k: int, groups: int) -> DataFrame:
    """``_id, _k, _n, sums``: a point goes to one cell for each group, the cell of that group and its own."""
    own = F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    dealt = points.select("*", own.alias("_own")).select("*", other.alias("_other")).select(
        (F.least("_own", "_other") * groups + F.greatest("_own", "_other")).alias("_cell"),
        (F.col("_other") < F.col("_own")).cast("int").alias("_side"), F.struct("_id", "_k", "_n").alias("_point"), "_v",
    )

    def rows(ids: pa.Array, sums: np.ndarray):
        lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, k, dtype="int32"), sums.ravel())
        return pa.RecordBatch.from_arrays([ids, lists], ["_point", "sums"])

    def run(batches):
        number, cell = None, None
        for batch in batches:
            numbers, sides = batch.column("_cell").to_numpy(), batch.column("_side").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(numbers)]):
                if a == b:
                    continue
                if numbers[a] != number:
                    if cell is not None and cell.settle():
                        yield rows(*cell.held_sums())
                    number = int(numbers[a])
                    cell = _Cell(number // groups == number % groups, k)
                part = batch.slice(int(a), int(b - a))
                who, vectors = part.column("_point"), matrix(part.column("_v"))
                _, clusters, weights = (x.to_numpy() for x in who.flatten())
                members = np.zeros((len(who), k))
                members[np.arange(len(who)), clusters] = weights
                if sides[a] == 0:
                    cell.hold(who, vectors, members)
                elif cell.settle():
                    yield rows(who, cell.meet(vectors, members))
        if cell is not None and cell.settle():
            yield rows(*cell.held_sums())

    cells = groups * (groups + 1) // 2
    met = dealt.repartition(cells, "_cell").sortWithinPartitions("_cell", "_side")
    parts = met.mapInArrow(run, "_point struct<_id: bigint, _k: int, _n: bigint>, sums array<double>")
    summed = parts.groupBy("_point").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    return summed.select("_point.*", "sums")
