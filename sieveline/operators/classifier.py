"""Label encoding, the stratified split, the class-balanced classifier and its probabilities."""

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.binding import let

# Share of test rows, seed and iteration limit of the standard build.
TEST_SHARE = 0.2
SEED = 42
MAX_ITER = 2000
# Rows that a hash bucket of the largest class holds at most on average while the split is drawn.
BUCKET_ROWS = 100_000


def label_index(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """0-based position of each label among the sorted distinct labels."""
    indexer = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc")
    ready = df.withColumn("_label", F.col(label).cast("string"))
    return indexer.fit(ready).transform(ready).withColumn(out, F.col("_index").cast("long")).drop("_label", "_index")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight`` with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))


def test_quotas(df: DataFrame, label: str = "label", test_share: float = TEST_SHARE) -> DataFrame:
    """``label, n, quota``: test rows per class, by largest remainder, adding up to ceil(share * n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # Whole-number arithmetic, so that remainders compare exactly.
    sized = counts.withColumn("rows", counts.agg(F.sum("n")).scalar())
    sized = sized.withColumn("wanted", F.ceil(F.lit(float(test_share)) * F.col("rows")))
    share = sized.select(
        label,
        "n",
        "wanted",
        F.expr("(n * wanted) div rows").alias("base"),
        F.expr("(n * wanted) % rows").alias("rest"),
    )
    everyone = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everyone.orderBy(F.desc("rest"), label))
    spare = F.col("wanted") - F.sum("base").over(everyone)
    return share.select(
        label, "n", (F.col("base") + F.when(place <= spare, 1).otherwise(0)).alias("quota")
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "id",
    seed: int = SEED,
    test_share: float = TEST_SHARE,
) -> DataFrame:
    """The rows with ``split`` = test or train; a class sends its quota of smallest hashes to test.

    The hash of (seed, key) alone decides, so the split can be rebuilt at any time. Counting a
    class by hash bucket shows the one bucket its quota cuts; all other rows are settled by
    comparing their bucket with it, without a shuffle, and only the cut buckets are sorted. A
    class holding most rows costs no more than any other: the number of buckets follows its size.
    Rows without a label are a class of their own.
    """
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / BUCKET_ROWS), 16)) + 1)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    hashed = df.withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, digits))
    buckets = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    quotas = test_quotas(df, label, test_share).select(F.col(label).alias("_class"), "quota")
    counted = buckets.withColumn("_upto", F.sum("_n").over(upto))
    running = counted.join(quotas, counted[label].eqNullSafe(quotas["_class"])).drop("_class")
    room = F.col("quota") - (F.col("_upto") - F.col("_n"))
    overfull = F.when(F.col("_upto") > F.col("quota"), F.struct(F.col("_bucket").alias("at"), room.alias("room")))
    cuts = running.groupBy(F.col(label).alias("_class")).agg(F.min(overfull).alias("_cut"))

    placed = hashed.join(cuts, hashed[label].eqNullSafe(cuts["_class"])).drop("_class")
    at = F.col("_cut.at")
    is_cut = F.coalesce(F.col("_bucket") == at, F.lit(False))
    settled = placed.filter(~is_cut).withColumn(
        "split", F.when(at.isNull() | (F.col("_bucket") < at), "test").otherwise("train")
    )
    order = Window.partitionBy(label).orderBy("_hash", key)
    drawn = placed.filter(is_cut).withColumn(
        "split", F.when(F.row_number().over(order) <= F.col("_cut.room"), "test").otherwise("train")
    )
    return settled.unionByName(drawn).select(*df.columns, "split")


def split_counts(split: DataFrame, label: str = "label") -> DataFrame:
    """``n_train, n_test, classes`` in one row."""
    return split.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        F.sort_array(F.collect_set(F.col(label).cast("string"))).alias("classes"),
    )


def train_classifier(train: DataFrame, label: str = "label", vector: str = "embedding") -> PipelineModel:
    """Class-balanced multinomial logistic regression on the vectors.

    The penalty 1 / (sum of weights) makes the objective equal to an L2-penalised fit with unit
    penalty weight on the summed loss; balanced weights add up to the number of rows.
    """
    counts = {
        str(r[0]): r[1]
        for r in train.groupBy(F.col(label).cast("string")).agg(F.count(F.lit(1))).collect()
    }
    classes, rows = sorted(counts), sum(counts.values())
    weights = F.create_map(*[F.lit(x) for c in classes for x in (c, rows / (len(classes) * counts[c]))])
    ready = train.select(
        F.col(label).cast("string").alias("label_text"),
        array_to_vector(F.col(vector)).alias("features"),
    ).withColumn("weight", F.element_at(weights, F.col("label_text")))
    indexer = StringIndexerModel.from_labels(classes, inputCol="label_text", outputCol="label_index")
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label_index",
        weightCol="weight",
        family="multinomial",
        standardization=False,
        maxIter=MAX_ITER,
        regParam=1.0 / max(1, rows),
        tol=1e-6,
    )
    return PipelineModel(stages=[indexer, regression.fit(indexer.transform(ready))])


def model_classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def ranked_probabilities(classes: list[str], probabilities: Column) -> Column:
    """``array<struct<class, p>>`` from the most to the least likely, ties in class order."""
    names = F.lit(classes)
    keyed = F.sort_array(
        F.transform(
            probabilities,
            lambda p, i: F.struct((-p).alias("key"), i.alias("at"), p.alias("p")),
        )
    )
    return let(
        keyed,
        lambda rows: F.transform(
            F.slice(rows, 1, len(classes)),
            lambda r: F.struct(F.get(names, r["at"]).alias("class"), r["p"].alias("p")),
        ),
    )


def class_probabilities(
    model: PipelineModel, df: DataFrame, vector: str = "embedding", out: str = "ml_probs"
) -> DataFrame:
    """The rows with their ranked class probabilities; no shuffle."""
    classes = model_classes(model)
    ready = df.withColumn("features", array_to_vector(F.col(vector)))
    scored = model.stages[-1].transform(ready)
    return scored.withColumn(out, ranked_probabilities(classes, vector_to_array(F.col("probability")))).select(
        *df.columns, out
    )


def top_classes(ranked: Column, k: int = 3) -> Column:
    """The k most likely classes with percent."""
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(
            r["class"].alias("domain"), r["p"].alias("prob"), (r["p"] * 100.0).alias("pct")
        ),
    )


def max_probability(ranked: Column) -> Column:
    return F.coalesce(F.get(ranked, F.lit(0))["p"], F.lit(0.0))
