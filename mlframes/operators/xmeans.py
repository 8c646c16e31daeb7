"""X-means (Pelleg and Moore, 2000): k-means that finds its own k by the BIC."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from mlframes.functions.likelihood import bic_penalty, log_likelihood
from mlframes.operators.cluster import SEED, best_of, vectors
from mlframes.operators.starts import Clusters, drawn_points, plus_plus, settle
from mlframes.plans.joins import join_on

PARTS = 2  # fixed value: parts a cluster is split into


def _spread(df: DataFrame, keys) -> DataFrame:
    """(keys, n, variance): rows and summed per-dimension sample variance, merged without cancellation."""
    summary = Summarizer.metrics("count", "variance").summary(F.col("features"))
    s = df.groupBy(*keys).agg(summary.alias("s"))
    total = F.aggregate(vector_to_array(F.col("s.variance")), F.lit(0.0), lambda a, x: a + x)
    return s.select(*keys, F.col("s.count").alias("n"), total.alias("variance"))


def bic_round(df: DataFrame, n_features: int, cluster: str = "cluster", part: str = "part") -> DataFrame:
    """(cluster, n, bic_before, bic_after, split) from points with a ``features`` vector, their cluster and
    the half of it they fall in. The variance is the squared error over n-1 before and over n-2 in a half;
    clusters and halves of at most two points are left out."""
    whole = _spread(df, [cluster]).where(F.col("n") > PARTS)
    halves = _spread(df, [cluster, part]).where(F.col("n") > PARTS).withColumnsRenamed({"n": "m", "variance": "v"})
    before = (log_likelihood(F.col("n"), F.col("n"), F.col("variance"), n_features, 1) - bic_penalty(F.col("n"), 1, n_features))
    within = F.col("v") * (F.col("m") - 1) / (F.col("m") - PARTS)
    likelihood = F.when(F.col("m").isNotNull(), log_likelihood(F.col("n"), F.col("m"), within, n_features, PARTS)).otherwise(0.0)
    both = join_on(whole, halves, [cluster], "left")
    out = both.groupBy(cluster, "n", before.alias("bic_before")).agg(F.sum(likelihood).alias("__l"))
    out = out.withColumn("bic_after", F.col("__l") - bic_penalty(F.col("n"), PARTS, n_features)).drop("__l")
    return out.withColumn("split", F.col("bic_before") < F.col("bic_after"))


def split_clusters(assigned: DataFrame, cluster: str = "cluster", max_iter: int = 1000, n_init: int = 10, seed: int = SEED) -> DataFrame:
    """Add ``part`` (0 or 1): every cluster cut in two by the cheapest of ``n_init`` runs of 2-means, all clusters and runs in
    the same passes.

    The first run of a cluster starts one deviation to either side of its mean along its widest feature, the others from
    points drawn by k-means++.
    """
    points = assigned.select(F.col(cluster).cast("int").alias("group"), vector_to_array("features").alias("point"))
    summary = Summarizer.metrics("mean", "variance").summary(F.col("features"))
    drawn, starts = drawn_points(points, "group", 200), []
    for r in assigned.groupBy(F.col(cluster).cast("int").alias("group")).agg(summary.alias("s")).collect():  # one row per cluster
        mean, variance = r["s"]["mean"].toArray(), np.nan_to_num(r["s"]["variance"].toArray())
        step = np.where(np.arange(len(mean)) == variance.argmax(), variance.max() ** 0.5, 0.0)
        starts.append((r["group"], np.array([mean - step, mean + step])))
        starts += [(r["group"], plus_plus(drawn[r["group"]], PARTS, np.random.default_rng([seed, i, r["group"]]))) for i in range(1, n_init)]
    best = {}
    for (group, _), found in zip(starts, settle(points, starts, max_iter)):
        if group not in best or found.cost < best[group].cost:
            best[group] = found
    return _nearer(assigned, {g: c.centres for g, c in best.items()}, cluster)


def _nearer(assigned: DataFrame, centres: dict, cluster: str) -> DataFrame:
    """Which of its cluster's two centres each point is nearer to: the side of the plane between them."""
    spark = assigned.sparkSession
    rows = [(c, (b - a).tolist(), float((b @ b - a @ a) / 2)) for c, (a, b) in centres.items()]
    planes = F.broadcast(spark.createDataFrame(rows, "__c int, __normal array<double>, __offset double"))
    side = F.expr("aggregate(zip_with(__point, __normal, (a, b) -> a * b), 0D, (s, x) -> s + x) > __offset")
    return (assigned.withColumn("__point", vector_to_array("features")).join(planes, F.col(cluster) == F.col("__c"))
            .withColumn("part", side.cast("int")).drop("__point", "__c", "__normal", "__offset"))


def fit_xmeans(df: DataFrame, features=None, id_col: str | None = None, kmax: int = 50, max_rounds: int = 100,
               n_init: int = 10, max_iter: int = 1000, seed: int = SEED) -> tuple[Clusters, list[int]]:
    """(model, k of each round). From k = 2, k grows by the clusters whose BIC rises when cut in two, until none
    does or ``kmax`` is reached; the model has the k of the last round before growth."""
    if kmax < 1:
        raise ValueError("kmax must be at least 1")
    data = vectors(df, features, id_col).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_features = data.first()["features"].size
        k, rounds = 2, []
        while len(rounds) < max_rounds:
            rounds.append(k)
            model = best_of(data, k, n_init, max_iter, seed)
            assigned = model.transform(data).persist(StorageLevel.MEMORY_AND_DISK)
            grown = bic_round(split_clusters(assigned, n_init=n_init, max_iter=max_iter, seed=seed), n_features).where("split").count()
            assigned.unpersist()
            k += grown
            if grown == 0 or k >= kmax:
                break
        return model, rounds
    finally:
        data.unpersist()


def point_vectors(df: DataFrame, point: str) -> DataFrame:
    """Add ``features``, the vector of an array column."""
    return df.withColumn("features", array_to_vector(F.col(point).cast("array<double>")))
