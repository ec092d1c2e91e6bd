import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import classifier as C
from sieveline.operators import metrics as M


def labelled(spark, sizes):
    rows = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("C",), ("b",)], "label string")
    assert sorted((r["label"], r["label_id"]) for r in C.label_index(df).collect()) == [("C", 0), ("a", 1), ("b", 2), ("b", 2)]


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 51, "c": 2}, {"x": 7, "y": 7, "z": 7}, {"one": 5000, "two": 13}])
def test_split_is_stratified_and_complete(spark, sizes):
    df = labelled(spark, sizes).repartition(3)
    split = C.stratified_split(df, "label", "id")
    rows = {r["id"]: (r["label"], r["split"]) for r in split.collect()}
    total = sum(sizes.values())
    assert len(rows) == total == split.count()
    wanted = math.ceil(0.2 * total)
    assert sum(s == "test" for _, s in rows.values()) == wanted
    for label, n in sizes.items():
        got = sum(s == "test" for k, s in rows.values() if k == label)
        assert abs(got - n * wanted / total) < 1
    again = {r["id"]: r["split"] for r in C.stratified_split(df.repartition(5), "label", "id").collect()}
    assert again == {i: s for i, (_, s) in rows.items()}
    other = {r["id"]: r["split"] for r in C.stratified_split(df, "label", "id", seed=1).collect()}
    assert other != again


def test_split_keeps_rows_without_a_label(spark):
    df = labelled(spark, {"a": 30}).unionByName(spark.range(10).selectExpr("concat('n', id) as id", "cast(null as string) as label"))
    rows = C.stratified_split(df, "label", "id").collect()
    assert len(rows) == 40 and sum(r["split"] == "test" and r["label"] is None for r in rows) == 2


def test_split_takes_the_smallest_hashes(spark):
    import hashlib

    df = labelled(spark, {"a": 9000, "b": 100})
    got = {r["id"] for r in C.stratified_split(df, "label", "id").filter("split = 'test'").collect()}
    ids = {k: sorted((f"{k}{i}" for i in range(n)), key=lambda d: hashlib.md5(f"42|{d}".encode()).hexdigest()) for k, n in (("a", 9000), ("b", 100))}
    assert got == set(ids["a"][:1800]) | set(ids["b"][:20])


def test_class_weights(spark):
    got = {r["label"]: (r["n"], r["weight"]) for r in C.class_weights(labelled(spark, {"a": 6, "b": 2})).collect()}
    assert got == {"a": (6, pytest.approx(8 / 12)), "b": (2, pytest.approx(2.0))}


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    centers = {"a": (0, 0), "b": (3, 0), "c": (0, 3)}
    sizes = {"a": 120, "b": 20, "c": 40}
    rows = [
        (f"{k}{i}", k, (rng.normal(size=2) * 0.8 + centers[k]).tolist()) for k, n in sizes.items() for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id string, label string, embedding array<double>")
    return df, C.train_classifier(df)


def test_classifier_minimises_the_balanced_penalised_loss(fitted):
    """The gradient of sum(weight * log loss) + |w|^2 / 2 vanishes at the fitted coefficients."""
    df, model = fitted
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows])
    names = C.model_classes(model)
    assert names == ["a", "b", "c"]
    y = np.array([names.index(r["label"]) for r in rows])
    weight = (len(y) / (3 * np.bincount(y)))[y]
    lr = model.stages[-1]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = (weight[:, None] * (p - np.eye(3)[y])).T @ x + w
    assert np.abs(gradient).max() < 0.05 * len(y) ** 0.5
    assert (p.argmax(1) == y).mean() > 0.9


def test_probabilities(fitted):
    df, model = fitted
    out = C.class_probabilities(model, df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        ps = [e["p"] for e in r["ml_probs"]]
        assert ps == sorted(ps, reverse=True) and sum(ps) == pytest.approx(1.0)
        assert {e["class"] for e in r["ml_probs"]} == {"a", "b", "c"}
    top = out.select(C.top_classes(F.col("ml_probs"), 2).alias("t"), C.max_probability(F.col("ml_probs")).alias("m")).first()
    assert len(top["t"]) == 2 and top["t"][0]["pct"] == pytest.approx(100 * top["m"])


def test_ranked_probability_ties_keep_class_order(spark):
    df = spark.createDataFrame([([0.25, 0.5, 0.25],), ([],), (None,)], "p array<double>")
    rows = [r[0] for r in df.select(C.ranked_probabilities(["x", "y", "z"], F.col("p"))).collect()]
    assert [e["class"] for e in rows[0]] == ["y", "x", "z"]
    assert rows[1] == [] and rows[2] is None
    assert df.select(C.max_probability(C.ranked_probabilities(["x"], F.col("p")))).collect()[2][0] == 0.0


PREDS = [
    # truth 0, predicted 0 / truth 0, predicted 1 (truth second) / truth 2 never predicted (third) / truth 9 is no class
    (1, 0, [0.7, 0.2, 0.1, 0.0]),
    (2, 0, [0.3, 0.6, 0.05, 0.05]),
    (3, 2, [0.4, 0.35, 0.2, 0.05]),
    (4, 9, [0.1, 0.1, 0.1, 0.7]),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(d, y, k, p) for d, y, ps in PREDS for k, p in enumerate(ps)]
    return M.outcomes(spark.createDataFrame(rows, "doc_id int, y_true int, class int, p double"))


def test_metrics(results):
    got = M.metrics_summary(results).first().asDict()
    # Classes 0, 1, 2, 3, 9; only class 0 has hits: precision 1/2, recall 1/2.
    assert got == {
        "accuracy": 0.25,
        "precision_macro": pytest.approx(0.1),
        "recall_macro": pytest.approx(0.1),
        "f1_macro": pytest.approx(0.1),
        "top3_accuracy": 0.75,
        "precision_at_3": 0.75,
        "mrr": pytest.approx((1 + 1 / 2 + 1 / 3 + 0) / 4),
    }
    assert M.accuracy(results).first()[0] == 0.25
    assert M.top_k_accuracy(results, 2).first()[0] == 0.5
    assert M.precision_at_k(results, 1).first()["precision_at_1"] == 0.25
    assert M.mean_reciprocal_rank(results).first()[0] == got["mrr"]
    assert M.macro_prf(M.confusion_counts(results)).first()["f1_macro"] == got["f1_macro"]


def test_class_report(results):
    report = M.class_report(M.confusion_counts(results))
    got = {r["class"]: tuple(r)[1:] for r in report.collect()}
    assert got == {0: (0.5, 0.5, 0.5, 2), 1: (0, 0, 0, 0), 2: (0, 0, 0, 1), 3: (0, 0, 0, 0), 9: (0, 0, 0, 1)}
    averages = {r["average"]: tuple(r)[1:] for r in M.report_averages(report).collect()}
    assert averages["macro avg"] == (pytest.approx(0.1), pytest.approx(0.1), pytest.approx(0.1), 4)
    assert averages["weighted avg"] == (0.25, 0.25, 0.25, 4)


def test_metrics_of_nothing(results):
    got = M.metrics_summary(results.limit(0)).first().asDict()
    assert set(got.values()) == {0.0}
    assert M.mean_reciprocal_rank(results.limit(0)).first()[0] == 0.0
