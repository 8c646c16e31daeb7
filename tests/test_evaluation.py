"""Metrics, curves, deltas and array functions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from mlframes.functions import arrays, bins
from mlframes.operators import curves, deltas, metrics


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_confusion_fills_missing_pairs(frame):
    df = frame([("a", "a"), ("a", "b"), ("b", "c")], "t string, p string")
    out = rows_of(metrics.confusion_matrix(df, "t", "p", "recall"), "truth", "predicted")
    assert len(out) == 9 and sum(r["n"] for r in out.values()) == 3
    assert out["a", "b"]["share"] == 0.5 and out["b", "b"]["share"] == 0.0 and out["c", "a"]["share"] is None


def test_unknown_predictions(frame):
    df = frame([("a", "a"), ("a", "z"), ("b", "b")], "t string, p string")
    dropped = rows_of(metrics.confusion_matrix(df, "t", "p", unknown="drop"), "truth", "predicted")
    assert sum(r["n"] for r in dropped.values()) == 2
    mapped = rows_of(metrics.confusion_matrix(df, "t", "p", unknown="map", unknown_to="b"), "truth", "predicted")
    assert mapped["a", "b"]["n"] == 1
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, "t", "p", unknown="other")


def test_class_report_weighted_row(frame):
    df = frame([("a", "a")] * 3 + [("a", "b"), ("b", "b")], "t string, p string")
    out = rows_of(metrics.class_report(df, "t", "p"), "class")
    assert out["a"]["recall"] == 0.75 and out["b"]["precision"] == 0.5 and out["a"]["f1"] == pytest.approx(6 / 7)
    assert out["avg / total"]["support"] == 5
    assert out["avg / total"]["precision"] == pytest.approx((4 * 1 + 1 * 0.5) / 5)


def test_one_class_only(frame):
    df = frame([("a", "a"), ("a", "a")], "t string, p string")
    assert rows_of(metrics.class_report(df, "t", "p"), "class")["a"]["f1"] == 1.0


def test_roc_counts_the_threshold_itself(frame):
    # 0.07 * 100 and 0.29 * 100 are not whole in binary
    scores = [0.0, 0.07, 0.29, 0.57, 1.0, float("nan")]
    df = frame([(i % 2, p) for i, p in enumerate(scores)], "y int, p double")
    out = {round(r["threshold"] * 100): r for r in curves.roc_curve(df, "y", "p").collect()}
    assert len(out) == 101
    for i in range(101):
        for label, name in ((1, "tpr"), (0, "fpr")):
            mine = [p for k, p in enumerate(scores) if k % 2 == label]
            assert out[i][name] == pytest.approx(sum(p >= i * 0.01 for p in mine) / 3)


def test_profit_is_strict_and_best_is_first(frame):
    df = frame([(1, 0.5), (0, 0.2)], "y int, p double")
    curve = curves.profit_curve(df, "y", "p", [[0, -1], [-2, 4]])
    out = {round(r["threshold"] * 100): r["profit"] for r in curve.collect()}
    assert out[49] == 2.0 and out[50] == -1.0 and out[0] == 1.5
    best = curves.best_threshold(curve).first()
    assert best["threshold"] == pytest.approx(0.2) and best["profit"] == 2.0


def test_scores_outside_the_unit_range(frame):
    df = frame([(1, 3.0), (0, -2.0)], "y int, p double")
    out = curves.roc_curve(df, "y", "p").collect()
    assert all(r["tpr"] == 1.0 and r["fpr"] == 0.0 for r in out)


def test_auc_with_ties_and_groups(frame):
    rows = [("m", 1, 0.9), ("m", 0, 0.9), ("m", 1, 0.4), ("m", 0, 0.1), ("n", 1, 1.0), ("n", 0, 0.0)]
    out = rows_of(curves.auc(frame(rows, "model string, y int, p double"), "y", "p", ["model"]), "model")
    assert out["m"]["auc"] == pytest.approx((0.5 + 1 + 1 + 0) / 4)
    assert out["n"]["auc"] == 1.0 and out["m"]["auc_hard"] == 0.5


def test_auc_of_one_class_is_null(frame):
    assert curves.auc(frame([(1, 0.3), (1, 0.4)], "y int, p double"), "y", "p").first()["auc"] is None


@pytest.mark.parametrize("actual, predicted, k, want", [
    (["a", "b"], ["a", "a", "b"], 3, (1 + 2 / 3) / 2),
    ([], ["a"], 5, 0.0), (["a"], [], 5, 0.0), (["a", "b", "c"], ["c"], 2, 0.5),
    (["a"], ["x", "a"], 1, 0.0), (["x", "y", "z"], ["x", "q", "y", "x", "z"], 5, (1 + 2 / 3 + 3 / 5) / 3)])
def test_average_precision(frame, actual, predicted, k, want):
    df = frame([(actual, predicted)], "a array<string>, p array<string>")
    assert df.select(arrays.average_precision("a", "p", k)).first()[0] == pytest.approx(want)


def test_mean_average_precision(frame):
    df = frame([(["a"], ["a"]), (["a"], ["b"])], "a array<string>, p array<string>")
    assert metrics.mean_average_precision(df, "a", "p").first()[0] == 0.5


def test_top_classes_ties_go_to_the_higher_position(frame):
    df = frame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(arrays.top_n_classes("p", 2)).first()[0] == [2, 1]
    assert df.select(arrays.class_names(arrays.top_n_classes("p", 5), ["x", "y", "z"])).first()[0] == ["z", "y", "x"]


def test_argmax_first_column_wins(frame):
    df = frame([(1, 1, 0), (0, 0, 2)], "a int, b int, c int")
    assert sorted(r[0] for r in df.select(arrays.argmax_column(["a", "b", "c"])).collect()) == ["a", "c"]


def test_rating_bins_are_closed_on_the_right(frame):
    df = frame([(v,) for v in (0.0, 3.99, 4.0, 4.99, 5.0, 5.01, -0.1, None)], "v double")
    out = {r[0]: r[1] for r in df.select("v", bins.rating_bin("v")).collect()}
    assert out == {0.0: "(-0.001, 3.99]", 3.99: "(-0.001, 3.99]", 4.0: "(3.99, 4.99]", 4.99: "(3.99, 4.99]",
                   5.0: "(4.99, 5.0]", 5.01: "Missing", -0.1: "Missing", None: "Missing"}


def test_mape_zero_rules(frame):
    df = frame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert tuple(metrics.mape(df, "y", "p").first()) == (50.0, 1)
    assert metrics.mape(df, "y", "p", zero="inf").first()[0] == float("inf")


def test_regression_metrics_can_be_chosen(frame):
    df = frame([("Train", 1.0, 2.0), ("Train", 3.0, 3.0)], "split string, y double, p double")
    out = {(r["set"], r["metric"]): r["value"] for r in metrics.regression_metrics(df, "y", "p", metrics=["mae", "rmse"]).collect()}
    assert out == {("Train", "mae"): 0.5, ("Train", "rmse"): pytest.approx(0.5 ** 0.5)}


def test_fuzzy_bands_are_strict(frame):
    df = frame([(10.0, 12.0, 2.0), (10.0, 11.0, 2.0), (10.0, 30.0, 2.0)], "y double, p double, s double")
    assert metrics.fuzzy_accuracy(df, "y", "p", "s").first()[0] == pytest.approx(1 / 3)
    assert {r["p"]: r["which_std"] for r in metrics.fuzzy_bands(df, "y", "p", "s").collect()} == {12.0: 2, 11.0: 0, 30.0: 2}
    assert {r["p"]: r["which_std"] for r in metrics.fuzzy_bands(df, "y", "p", "s", True).collect()} == {12.0: 1, 11.0: 0, 30.0: 2}


def test_deltas_with_an_unknown_label(frame):
    df = frame([("a", "a", "b"), ("a", "b", "a"), ("b", "b", "z"), ("b", "b", "b")], "t string, p string, q string")
    out = rows_of(deltas.delta_matrix(df, "t", "p", "q", unknown="drop"), "truth", "predicted")
    assert out["a", "a"]["delta"] == 0.0 and out["b", "b"]["delta"] == 0.0
    out = rows_of(deltas.delta_matrix(df, "t", "p", "q", unknown_to="a"), "truth", "predicted")
    assert out["b", "a"]["delta"] == 0.5 and out["b", "b"]["delta"] == -0.5
    scores = rows_of(deltas.delta_recall_precision(df, "t", "p", "q"), "class")
    assert scores["a"]["delta_recall"] == 0.0 and scores["b"]["delta_precision"] == pytest.approx(0.5 - 2 / 3)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(frame, parts):
    rows = [(i % 2, (i * 37 % 101) / 100) for i in range(400)]
    df = frame(rows, "y int, p double", parts)
    assert sorted(map(tuple, curves.roc_curve(df, "y", "p").collect()))[50] == (
        0.5, *[sum(p >= 0.5 for y, p in rows if y == k) / 200 for k in (1, 0)])


def test_accuracy_table(frame):
    df = frame([(1, 1, 0), (0, 0, 0)], "y int, a int, b int")
    out = metrics.accuracy_table(df, "y", {"A": "a", "B": "b"})
    assert {r["Classifier"]: r["Test Accuracies"] for r in out.collect()} == {"A": 1.0, "B": 0.5}


def test_empty_input(spark):
    df = spark.createDataFrame([], "t string, p string")
    assert metrics.confusion_matrix(df, "t", "p").count() == 0
    assert curves.roc_curve(spark.createDataFrame([], "y int, p double"), "y", "p").select(F.count("tpr")).first()[0] == 0
