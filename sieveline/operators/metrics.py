"""Evaluation metrics over ``doc_id, y_true, class, p`` (one row per document and class)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_classes(preds: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), F.asc("class"))
    return preds.withColumn("rank", F.row_number().over(order).cast("long"))


def outcomes(preds: DataFrame) -> DataFrame:
    """``doc_id, y_true, y_pred, truth_rank``; the rank is null when the truth is no class.

    Grouping reuses the partitioning of the ranking: one shuffle.
    """
    return (
        ranked_classes(preds)
        .groupBy("doc_id", "y_true")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("class"))).alias("y_pred"),
            F.max(F.when(F.col("class") == F.col("y_true"), F.col("rank"))).alias("truth_rank"),
        )
    )


def confusion_counts(results: DataFrame) -> DataFrame:
    """``y_true, y_pred, n``."""
    return results.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(results: DataFrame) -> DataFrame:
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return results.agg(F.coalesce(hit, F.lit(0.0)).alias("accuracy"))


def top_k_accuracy(results: DataFrame, k: int = 3) -> DataFrame:
    hit = F.coalesce(F.col("truth_rank") <= k, F.lit(False)).cast("double")
    return results.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias(f"top{k}_accuracy"))


def precision_at_k(results: DataFrame, k: int = 3) -> DataFrame:
    """Defined as top-k accuracy."""
    return top_k_accuracy(results, k).withColumnRenamed(f"top{k}_accuracy", f"precision_at_{k}")


def mean_reciprocal_rank(results: DataFrame) -> DataFrame:
    gain = F.coalesce(F.lit(1.0) / F.col("truth_rank"), F.lit(0.0))
    return results.agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("mrr"))


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _class_sums(cells: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``class, support, predicted, hit`` plus the extra sums of the true class.

    Input is one row per (truth, prediction), classes squared at most; each row counts once for
    its true class and once for its predicted class, which saves joining the two views.
    """
    zero = F.lit(0).cast("long")
    as_truth = F.struct(
        F.col("y_true").alias("class"),
        F.col("n").alias("support"),
        zero.alias("predicted"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("hit"),
        *[F.col(c).cast("double").alias(c) for c in extra],
    )
    as_prediction = F.struct(
        F.col("y_pred").alias("class"),
        zero.alias("support"),
        F.col("n").alias("predicted"),
        zero.alias("hit"),
        *[F.lit(0.0).alias(c) for c in extra],
    )
    return (
        cells.select(F.explode(F.array(as_truth, as_prediction)).alias("r"))
        .select("r.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit", *extra)])
    )


def _scores():
    """Precision, recall and F1 of a class; 0 where the denominator is 0."""
    return {
        "precision": _ratio(F.col("hit"), F.col("predicted")),
        "recall": _ratio(F.col("hit"), F.col("support")),
        "f1": _ratio(2.0 * F.col("hit"), F.col("support") + F.col("predicted")),
    }


def class_report(confusion: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` from confusion counts."""
    scores = [c.alias(name) for name, c in _scores().items()]
    return _class_sums(confusion).select("class", *scores, "support")


def report_averages(report: DataFrame) -> DataFrame:
    """``average, precision, recall, f1, support`` for the macro and the support-weighted average."""
    names = ("precision", "recall", "f1")
    one = report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
        F.sum("support").alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("average"),
                *[F.col(f"{kind}_{c}").alias(c) for c in names],
                F.col("support").alias("support"),
            )
            for kind in ("macro", "weighted")
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def macro_prf(confusion: DataFrame) -> DataFrame:
    return class_report(confusion).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def metrics_summary(results: DataFrame, k: int = 3) -> DataFrame:
    """The seven-metric summary in one row.

    One aggregation by (truth, prediction) carries the ranking sums too; everything after it
    works on classes squared rows.
    """
    cells = results.groupBy("y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col("truth_rank") <= k, F.lit(False)).cast("long")).alias("hits"),
        F.sum(F.coalesce(F.lit(1.0) / F.col("truth_rank"), F.lit(0.0))).alias("gain"),
    )
    scores = _scores()
    n = F.greatest(F.coalesce(F.sum("support"), F.lit(0)), F.lit(1))

    def share(column):
        return F.coalesce(F.sum(column), F.lit(0)) / n

    def macro(name):
        return F.coalesce(F.avg(scores[name]), F.lit(0.0)).alias(f"{name}_macro")

    return _class_sums(cells, ("hits", "gain")).agg(
        share("hit").alias("accuracy"),
        macro("precision"),
        macro("recall"),
        macro("f1"),
        share("hits").alias(f"top{k}_accuracy"),
        share("hits").alias(f"precision_at_{k}"),
        share("gain").alias("mrr"),
    )
