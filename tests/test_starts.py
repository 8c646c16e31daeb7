"""Many starts of k-means in the same passes, against plain Lloyd in numpy."""

import numpy as np
import pytest


from pyspark.ml.functions import array_to_vector

from mlframes.operators import cluster, starts


def lloyd(x, centres, max_iter):
    for _ in range(max_iter + 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        own, cost = d.argmin(1), d.min(1).sum()
        new = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if ((new - centres) ** 2).sum() == 0:
            break
        last, centres = centres, new
    else:
        return last, cost
    return centres, cost


@pytest.fixture()
def points(spark):
    x = np.random.default_rng(2).normal(size=(300, 3)) + 1e6 * np.array([1, -1, 0])
    rows = [(int(i % 2), p.tolist()) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "group int, point array<double>").repartition(5)


@pytest.mark.parametrize("max_iter, held", [(100, 64 << 20), (3, 64 << 20), (100, 1)])
def test_every_run_is_plain_lloyd(points, monkeypatch, max_iter, held):
    monkeypatch.setattr(starts, "CENTRE_BYTES", held)
    x, df = points
    rng = np.random.default_rng(0)
    wanted = [(g, starts.plus_plus(x[g::2], k, rng)) for g in (0, 1) for k in (1, 3, 4)]
    for (g, first), found in zip(wanted, starts.settle(df, wanted, max_iter)):
        centres, cost = lloyd(x[g::2], first, max_iter)
        assert found.cost == pytest.approx(cost, rel=1e-6)
        assert found.centres == pytest.approx(centres, rel=1e-9)


def test_more_starts_cost_no_more(points):
    x, df = points
    data = df.select(array_to_vector("point").alias("features"))
    few, many = (starts.best_of_starts(data, [4], n, 100, 1)[4].cost for n in (1, 12))
    assert many <= few


def test_saved_clusters_place_alike(spark, points, tmp_path):
    _, df = points
    data = df.select(array_to_vector("point").alias("features"))
    model = starts.best_of_starts(data, [3], 2, 50, 1)[3]
    model.save(spark, str(tmp_path / "c"))
    again = starts.Clusters.load(spark, str(tmp_path / "c"))
    assert again.cost == model.cost
    first, second = (sorted(map(str, m.transform(data).collect())) for m in (model, again))
    assert first == second


def test_fewer_points_than_centres(frame):
    df = frame([(1, 0.0), (2, 1.0), (3, 1.0)], "id int, x double")
    model = cluster.fit_kmeans(df, 3, id_col="id", n_init=2)
    assert model.cost == 0 and cluster.predict(model, df, "id").count() == 3


def test_passes_read_blocks_in_few_parts(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(500, 3))
    df = spark.createDataFrame([(i % 2, [float(v) for v in p]) for i, p in enumerate(x)], "group int, point array<double>").repartition(50)
    monkeypatch.setattr(starts, "BLOCK_BYTES", 480)
    packed = starts._packed(df, 3)
    assert packed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = {0: [], 1: []}
    for r in packed.collect():
        assert len(r["block"]) <= 480
        found[r["group"]] += np.frombuffer(r["block"]).reshape(-1, 3).tolist()
    assert {g: sorted(p) for g, p in found.items()} == {g: sorted(x[g::2].tolist()) for g in (0, 1)}
