"""Clustering, X-means, tree models, learning curves and importance."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from mlframes.operators import cluster, supervised, xmeans
from mlframes.sources import sinks

CENTRES = [(0, 0), (100, 0), (0, 100), (100, 100), (50, 300)]


UNEVEN = [(0, 0), (100, 40), (300, 0), (700, 90), (1500, 0)]  # every cut in two lowers the spread a lot


def blobs(frame, k, side=5, centres=CENTRES):
    """k square grids of points around far centres."""
    rows = [(i, float(cx + x), float(cy + y)) for i, (cx, cy, x, y) in enumerate(
        (cx, cy, x, y) for cx, cy in centres[:k] for x in range(side) for y in range(side))]
    return frame(rows, "id int, x double, y double")


def test_inertia_is_the_sum_of_squares(spark, frame):
    df = blobs(frame, 3)
    model = cluster.fit_kmeans(df, 3, id_col="id", n_init=2)
    assert model.summary.trainingCost == pytest.approx(3 * 2 * 5 * sum((i - 2) ** 2 for i in range(5)))
    placed = cluster.predict(model, df, "id").join(df, "id").withColumn("p", F.array("x", "y"))
    means = cluster.cluster_means(placed, "cluster", "p")
    assert cluster.inertia(placed, "cluster", "p", means).first()[0] == pytest.approx(model.summary.trainingCost)
    long = cluster.centroids(model, ["x", "y"], spark)
    assert long.count() == 6 and long.where("feature = 'x'").agg(F.max("value")).first()[0] == pytest.approx(102)


def test_cost_falls_with_k_and_the_knee_is_the_number_of_blobs(frame):
    models, costs = cluster.fit_many(blobs(frame, 4), [6, 2, 3, 4, 5, 8], id_col="id", n_init=4, max_iter=30)
    assert list(models) == [2, 3, 4, 5, 6, 8]
    values = [r["cost"] for r in costs.orderBy("k").collect()]
    assert values == sorted(values, reverse=True)
    k, model = cluster.choose_k(models, costs)
    assert k == 4 and len(model.clusterCenters()) == 4


def test_no_knee_on_a_straight_line(frame):
    assert cluster.knee(frame([(k, 10.0 - k) for k in range(2, 9)], "k int, cost double")).first()["knee"] is None
    assert cluster.choose_k({}, frame([(2, 1.0)], "k int, cost double")) == (None, None)


def brute_silhouette(points, labels, squared=False):
    points, labels = np.array(points, float), np.array(labels)
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    scores = []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(labels)) != i)
        if not mine.any():
            scores.append(0)
            continue
        a, b = d[i][mine].mean(), min(d[i][labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("tile", [7, 1000])
def test_silhouette_matches_brute_force(frame, tile):
    rng = np.random.default_rng(1)
    points, labels = rng.normal(size=(60, 3)).tolist(), (rng.integers(0, 3, 59).tolist() + [9])
    df = frame([(i, c, p) for i, (c, p) in enumerate(zip(labels, points))], "id int, c int, p array<double>")
    assert cluster.silhouette(df, "id", "c", "p", tile).first()[0] == pytest.approx(brute_silhouette(points, labels))
    assert cluster.silhouette_squared(df, "c", "p").first()[0] == pytest.approx(brute_silhouette(points, labels, True))


def test_report_counts_each_id_once(frame):
    predictions = frame([(1, 0), (1, 0), (2, 1), (3, 1)], "id int, cluster int")
    data = frame([(1, 5.0), (1, 7.0), (2, 1.0), (3, 3.0), (4, 9.0)], "id int, v double")
    detail, summary = cluster.cluster_report(predictions, data, "id", ["v"])
    assert detail.count() == 3
    assert {r["cluster"]: (r["cluster_count"], r["v"], r["cluster_precentage"]) for r in summary.collect()} == {
        0: (1, 5.0, pytest.approx(1 / 3)), 1: (2, 2.0, pytest.approx(2 / 3))}
    with pytest.raises(ValueError):
        cluster.join_predictions(predictions, data, "absent")


def test_report_rows_append(spark, frame, tmp_path):
    model = cluster.fit_kmeans(blobs(frame, 2), 2, id_col="id", n_init=1)
    row = cluster.model_report(model, 2, 50, spark, "id", folder="m")
    for _ in range(2):
        sinks.append_report(row, str(tmp_path / "report"))
    out = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert len(out) == 2 and out[0]["model_clusters"] == "2"


@pytest.mark.parametrize("k", [2, 3, 5])
def test_xmeans_finds_the_blobs(frame, k):
    model, rounds = xmeans.fit_xmeans(blobs(frame, k, 6, UNEVEN), id_col="id", n_init=6)
    assert rounds[0] == 2 and len(model.clusterCenters()) == rounds[-1] == k


def test_xmeans_returns_the_k_before_the_cap(frame):
    model, rounds = xmeans.fit_xmeans(blobs(frame, 5, 6), id_col="id", n_init=3, kmax=3)
    assert rounds == [2] and len(model.clusterCenters()) == 2
    with pytest.raises(ValueError):
        xmeans.fit_xmeans(blobs(frame, 2), kmax=0)


def test_all_clusters_split_in_the_same_passes(frame):
    df = blobs(frame, 4)
    points = cluster.vectors(df, id_col="id").join(df, "id").withColumn("cluster", (F.col("x") > 50).cast("int"))
    halves = xmeans.split_clusters(points)
    assert halves.count() == 100
    assert halves.groupBy("cluster", "part").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("hi - lo > 5").count() == 0
    gains = {r["cluster"]: r["split"] for r in xmeans.bic_round(halves, 2).collect()}
    assert gains == {0: True, 1: True}


def test_tiny_clusters_are_left_alone(frame):
    df = frame([(i, c, [float(i)]) for i, c in enumerate([0, 0, 1, 1, 1, 1])], "id int, cluster int, p array<double>")
    out = xmeans.bic_round(xmeans.point_vectors(df, "p").withColumn("part", F.col("id") % 2), 1).collect()
    assert [r["cluster"] for r in out] == [1]


def table(frame):
    rows = [(i, "Train" if i % 10 < 7 else "Validation" if i % 10 < 9 else "Test", float(i % 17), ["u", "v", "w"][i % 3], i % 2 == 0,
             3.0 * (i % 17) + (10 if i % 3 == 0 else 0)) for i in range(600)]
    return frame(rows, "id int, split string, a double, `b[x]` string, c boolean, y double")


def test_regression_learns_saves_and_validates(spark, frame, tmp_path):
    df = table(frame)
    model = supervised.train_regressor(df, "y", drop=["id", "absent"], rounds=20)
    assert model.features == ["a", "b_x_", "c"]
    out = {(r["set"], r["metric"]): r["value"] for r in model.validate(df).collect()}
    assert set(s for s, _ in out) == {"Train", "Validation", "Test"} and out["Test", "mae"] < 1.5
    model.save(spark, str(tmp_path))
    again = supervised.Trained.load(spark, str(tmp_path))
    assert again.features == model.features
    first, second = (m.score(df).orderBy("id").select("prediction").collect() for m in (model, again))
    assert first == second


def test_scoring_keeps_every_row_and_missing_values(frame):
    df = table(frame)
    model = supervised.train_regressor(df, "y", drop=["id"], rounds=3)
    holes = df.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")))
    assert model.score(holes).where("prediction is not null").count() == 600


@pytest.mark.parametrize("target", ["c", "b[x]"])
def test_classification_returns_class_names(frame, target):
    df = table(frame).withColumn("hint", F.col(f"`{target}`").cast("string"))
    if target == "b[x]":
        df = df.withColumnRenamed("b[x]", "kind")
        target = "kind"
    else:
        df = df.withColumn("c", F.when(F.col("c"), "yes").otherwise("no"))
    model = supervised.train_classifier(df, target, drop=["id", "y"], rounds=5)
    scored = model.score(df)
    assert scored.where(F.col("prediction") != F.col(target)).count() == 0
    p = model.score(df, probabilities=True, name="p").first()["p"]
    assert len(p) == len(model.classes) and sum(p) == pytest.approx(1)
    out = {(r["set"], r["metric"]): r["value"] for r in model.validate(df, metrics=["accuracy"]).collect()}
    assert out == {(s, "accuracy"): 1.0 for s in ("Train", "Validation", "Test")}


def test_importance_kinds(spark, frame, tmp_path):
    model = supervised.train_regressor(table(frame), "y", drop=["id"], rounds=5)
    nodes = supervised.tree_nodes(model.model, str(tmp_path / "trees"), spark)
    tables = {kind: {r["Features"]: r[f"{kind}_type"] for r in supervised.feature_importance(nodes, model.features, kind).collect()}
              for kind in supervised.IMPORTANCE_KINDS}
    assert max(tables["total_gain"], key=tables["total_gain"].get) == "a"
    for f in tables["weight"]:
        assert tables["total_gain"][f] == pytest.approx(tables["gain"][f] * tables["weight"][f])
        assert tables["total_cover"][f] == pytest.approx(tables["cover"][f] * tables["weight"][f])
    top = supervised.top_importance(supervised.feature_importance(nodes, model.features), "weight_type", 2).collect()
    assert len(top) == 2 and sum(r["share"] for r in top) == pytest.approx(1)


def test_classifiers_share_one_scaling(frame):
    df = table(frame).withColumn("label", (F.col("a") > 8).cast("int"))
    models = supervised.Classifiers({"tree": DecisionTreeClassifier(), "line": LogisticRegression()}, ["a", "y"], "label").train(df)
    scored = models.score(df)
    assert {"pred_tree", "proba_tree", "pred_line", "proba_line"} <= set(scored.columns) and scored.count() == 600
    assert scored.where("pred_tree != label").count() == 0


def test_learning_curve_improves(frame):
    df = table(frame)
    out = {(r["size"], r["set"]): r for r in supervised.learning_curve(
        df, ["a"], "y", "id", LinearRegression(), folds=3, sizes=[0.1, 1.0]).collect()}
    assert len(out) == 4 and all(r["mean"] < 0 and r["std"] >= 0 for r in out.values())
    assert out[0.1, "train"]["rows"] < out[1.0, "train"]["rows"] == pytest.approx(400)
    assert out[1.0, "validation"]["mean"] > -6


def test_report_describes_a_model_of_several_clusters(spark):
    from registry import QUERIES
    rows = {r["model_clusters"]: r for r in QUERIES["a24_model_report"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {1, 5} and all(r["inertia_is_cost"] for r in rows.values())


@pytest.mark.parametrize("tile", [7, 64, 10_000])
def test_silhouette_of_close_points_far_from_the_origin(frame, tile):
    rng = np.random.default_rng(8)
    near = np.repeat(rng.normal(size=(30, 5)) + 1e6, 3, axis=0)  # copies, and points a millionth apart
    points = near + rng.normal(size=near.shape) * 1e-6 * (np.arange(90) % 3 == 2)[:, None]
    labels = np.arange(90) // 3 % 4
    df = frame([(i, int(c), [float(v) for v in p]) for i, (p, c) in enumerate(zip(points, labels))], "id long, c int, p array<double>")
    assert cluster.silhouette(df, "id", "c", "p", tile).first()[0] == pytest.approx(brute_silhouette(points, labels), rel=1e-9)
