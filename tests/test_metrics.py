import numpy as np
import pytest

from labelpick.operators import metrics


def _naive(y, p):
    classes = sorted(set(y) | set(p))
    rows = []
    for c in classes:
        tp = sum(a == c and b == c for a, b in zip(y, p))
        fp = sum(a != c and b == c for a, b in zip(y, p))
        fn = sum(a == c and b != c for a, b in zip(y, p))
        rows.append((tp + fn, tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0,
                     2 * tp / (2 * tp + fp + fn) if tp else 0))
    rows = np.array(rows, float)
    weighted = (rows[:, 1:] * rows[:, :1]).sum(0) / rows[:, 0].sum()
    return np.mean(np.array(y) == np.array(p)), weighted, rows[:, 1:].mean(0)


def test_single_label_matches_definition(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 4, 80).tolist(), rng.integers(1, 6, 80).tolist()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, p))], "row_id long, label int, prediction int")
    row = metrics.summary_single(df).first()
    accuracy, weighted, macro = _naive(y, p)
    assert np.isclose(row["accuracy"], accuracy)
    assert np.allclose([row["precision"], row["recall"], row["f1"]], weighted)
    assert np.allclose([row["precision_macro"], row["recall_macro"], row["f1_macro"]], macro)


def test_class_seen_only_in_predictions_counts_in_macro_only(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 7)], "row_id long, label int, prediction int")
    row = metrics.summary_single(df).first()
    assert row["recall"] == 0.5 and row["recall_macro"] == 0.25


def test_confusion_holds_the_union_of_classes_and_zeros(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, 0, 0), (3, 2, 2)], "row_id long, label int, prediction int")
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 2): 1, (2, 0): 0, (2, 2): 1}
    wide = {r["label"]: (r["0"], r["2"]) for r in metrics.confusion_matrix(df, [0, 2]).collect()}
    assert wide == {0: (1, 1), 2: (0, 1)}


def test_multi_label_against_definition(spark):
    y, p, b = [[1, 0, 1], [0, 0, 1]], [[1, 1, 0], [0, 0, 1]], [[0.6, 0.5, 0.4], [0.1, 0.2, 0.9]]
    df = spark.createDataFrame(list(zip([1, 2], y, p, b)),
                               "row_id long, label array<int>, prediction array<int>, baseline array<double>")
    got = {r["metric"]: r for r in metrics.evaluate_multi(df).collect()}
    assert np.isclose(got["hamming_loss"]["model"], 2 / 6) and np.isclose(got["hamming_loss"]["baseline"], 1 / 6)
    assert np.isclose(got["precision"]["model"], 2 / 3) and np.isclose(got["recall"]["baseline"], 2 / 3)
    assert np.isclose(got["hamming_loss"]["percentage"], 50.0)  # baseline / model


def test_zero_baseline_gives_null_percentage(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (2, 1, 1, 0)], "row_id long, label int, prediction int, baseline int")
    got = {r["metric"]: r for r in metrics.evaluate_single(df).collect()}
    assert got["accuracy"]["baseline"] == 0.0 and got["accuracy"]["percentage"] is None


def test_without_baseline(spark):
    df = spark.createDataFrame([(1, 0, 0)], "row_id long, label int, prediction int")
    assert {r["metric"]: r["model"] for r in metrics.evaluate_single(df).collect()}["f1"] == 1.0


def test_one_hot_all_zero_prediction_is_class_zero(spark):
    rows = [(1, [1, 0], [0, 0]), (2, [0, 1], [1, 1])]
    df = spark.createDataFrame(rows, "row_id long, label array<int>, prediction array<int>")
    got = {r["metric"]: r["model"] for r in metrics.evaluate_one_hot(df).collect()}
    assert np.isclose(got["recall_macro"], 0.5) and np.isclose(got["precision_macro"], 0.25)


def test_label_weights(spark):
    df = spark.createDataFrame([(1, [1, 1]), (2, [0, 1]), (3, [0, 1]), (4, [0, 1])], "row_id long, label array<int>")
    rows = metrics.label_weights(df).orderBy("position").collect()
    assert np.allclose([r["frequency"] for r in rows], [0.25, 1]) and np.allclose([r["weight"] for r in rows], [0.8, 0.2])


@pytest.mark.parametrize("n_rows", [300])
def test_hot_class_is_one_aggregation(spark, n_rows):
    df = spark.range(n_rows).selectExpr("id AS row_id", "CAST(id % 3 = 0 AS int) AS label", "1 AS prediction")
    plan = metrics.pair_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert sum(r["n"] for r in metrics.pair_counts(df).collect()) == n_rows


def test_rows_without_prediction_are_not_lost(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int")
    guess = spark.createDataFrame([(1, 0)], "row_id long, prediction int")
    kept = metrics.align(truth, guess, missing="null").collect()
    assert {r["row_id"]: r["prediction"] for r in kept} == {1: 0, 2: None}
    with pytest.raises(Exception, match="no prediction for row 2"):
        metrics.align(truth, guess).collect()


def test_two_predictions_for_one_row_are_an_error(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int")
    twice = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "row_id long, prediction int")
    with pytest.raises(Exception, match="more than one prediction for row 2"):
        metrics.align(truth, twice).collect()
    with pytest.raises(Exception, match="more than one prediction for row 2"):
        metrics.align(truth, twice, missing="null").collect()
    once = metrics.align(truth, twice.filter("row_id = 1"), missing="null").orderBy("row_id").collect()
    assert [r["prediction"] for r in once] == [0, None]
