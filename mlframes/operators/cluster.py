"""K-means with restarts, choice of k, assignment and cluster reports."""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType
from pyspark.storagelevel import StorageLevel

from mlframes.functions.hashing import hash52
from mlframes.operators.starts import Clusters, best_of_starts
from mlframes.plans.groups import codes, run_starts
from mlframes.plans.joins import attach_small, join_on
from mlframes.plans.ranks import first_per_key, with_share

# Restarts, iterations and seed of a training run.
N_INIT, MAX_ITER, SEED = 25, 1000, 40


def feature_columns(df: DataFrame, features=None, id_col: str | None = None) -> list[str]:
    return [c for c in (features or df.columns) if c != id_col]


def vectors(df: DataFrame, features=None, id_col: str | None = None) -> DataFrame:
    """The id, when there is one, and the features as one vector column."""
    features = feature_columns(df, features, id_col)
    out = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return out.select(*([id_col] if id_col else []), "features")


def fit_kmeans(df: DataFrame, k: int, features=None, id_col: str | None = None, n_init: int = N_INIT,
               max_iter: int = MAX_ITER, seed: int = SEED) -> Clusters:
    """The cheapest of ``n_init`` runs, all in the same passes."""
    data = vectors(df, features, id_col).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return best_of(data, k, n_init, max_iter, seed)
    finally:
        data.unpersist()


def best_of(data: DataFrame, k: int, n_init: int, max_iter: int = MAX_ITER, seed: int = SEED) -> Clusters:
    """The cheapest of several runs on a cached frame with a ``features`` column."""
    return best_of_starts(data, [k], n_init, max_iter, seed)[k]


def fit_many(df: DataFrame, ks, features=None, id_col: str | None = None, n_init: int = N_INIT,
             max_iter: int = MAX_ITER, seed: int = SEED):
    """(models by k in ascending order, table (k, cost)); all ks and starts share the passes over the cached data."""
    data = vectors(df, features, id_col).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = best_of_starts(data, sorted({int(k) for k in ks}), n_init, max_iter, seed)
    finally:
        data.unpersist()
    costs = [(k, float(m.summary.trainingCost)) for k, m in models.items()]
    return models, df.sparkSession.createDataFrame(costs, "k int, cost double")


def centroids(model: Clusters, features, spark: SparkSession) -> DataFrame:
    """(cluster, feature, value)."""
    rows = [(i, f, float(v)) for i, c in enumerate(model.clusterCenters()) for f, v in zip(features, c)]
    return spark.createDataFrame(rows, "cluster int, feature string, value double")


def cluster_means(df: DataFrame, cluster: str, point: str) -> DataFrame:
    """(cluster, centre): mean of an array column per cluster; vectors are summed before the shuffle."""
    vector = array_to_vector(F.col(point).cast("array<double>"))
    means = df.select(F.col(cluster).alias("cluster"), vector.alias("v")).groupBy("cluster").agg(
        Summarizer.mean(F.col("v")).alias("m"))
    return means.select("cluster", vector_to_array("m").alias("centre"))


def inertia(df: DataFrame, cluster: str, point: str, centres: DataFrame) -> DataFrame:
    """One row: sum of squared distances of the points (arrays) to their centres (cluster, centre)."""
    placed = attach_small(df.select(F.col(cluster).alias("cluster"), F.col(point).alias("point")), centres, ["cluster"], "inner")
    squared = F.expr("aggregate(zip_with(point, centre, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)")
    return placed.agg(F.sum(squared).alias("inertia"))


# ---- silhouette --------------------------------------------------------------------------------

def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product; those of points that lie close together by their differences, which keeps
    their digits."""
    a, b = (left * left).sum(1)[:, None], (right * right).sum(1)[None, :]
    squared, both = a + b - 2 * left @ right.T, a + b
    i, j = np.nonzero(squared < 1e-6 * both)
    for start in range(0, len(i), 65_536):
        x, y = i[start:start + 65_536], j[start:start + 65_536]
        squared[x, y] = ((left[x] - right[y]) ** 2).sum(1)
    return np.sqrt(squared, out=squared)


def silhouette(df: DataFrame, id_col: str, cluster: str, point: str, tile_rows: int = 16_384) -> DataFrame:
    """One row: exact mean silhouette by Euclidean distance of an array column.

    Every point needs its mean distance to every cluster. Points are hashed into blocks of about
    ``tile_rows``, fewer if points are wide or clusters many; a task takes one pair of blocks, works out
    their distances once for both sides by matrix products and emits one sum per point and cluster, not
    one row per pair. A point travels once per block. Work is quadratic in the points, as the measure
    is; ``silhouette_squared`` is the linear-time relative.
    """
    points = df.select(F.col(id_col).alias("id"), F.col(cluster).cast("bigint").alias("cluster"),
                       F.col(point).cast("array<double>").alias("point"))
    rows, width, clusters = points.agg(F.count("*"), F.max(F.size("point")), F.count_distinct("cluster")).first()
    tile_rows = max(1, min(tile_rows, (32 << 20) // (8 * max(width or 1, 1)), (4 << 20) // max(clusters, 1)))
    blocks = max(1, math.ceil(rows / tile_rows))
    points = points.withColumn("block", F.pmod(hash52(SEED, "id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = points.withColumn("other", other).select("id", "cluster", "point", "block", F.least("block", "other").alias("low"),
                                                     F.greatest("block", "other").alias("high"))
    key_type = points.schema["id"].dataType.simpleString()

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("cluster", "ascending")]).combine_chunks()
        every = table.column("point").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        every = every - every.mean(0)  # the distances stay
        own, block = codes(table.column("cluster")), table.column("block").to_numpy()
        cut = int(np.searchsorted(block, block[-1]))  # 0: a block with itself, or with one that got no point
        alone = not cut and table.column("low")[0] != table.column("high")[0]
        left, right = np.arange(0 if alone else cut or len(block)), np.arange(cut, len(block))
        starts, runs = run_starts(own[left]), run_starts(own[right])
        of_left, of_right = np.empty((len(left), len(runs))), {}
        for begin, end in zip(starts, np.append(starts[1:], len(left))):
            total = np.zeros(len(right))
            for at in range(begin, end, 256):  # bounds the memory of the distances
                apart = _distances(every[left[at:min(at + 256, end)]], every[right])
                of_left[at:min(at + 256, end)] = np.add.reduceat(apart, runs, axis=1)
                total += apart.sum(0)
            of_right[begin] = total
        who, other = np.repeat(left, len(runs)), np.tile(right[runs], len(left))
        totals = of_left.ravel()
        if cut:
            who, other = np.concatenate([who, np.tile(right, len(starts))]), np.concatenate([other, np.repeat(left[starts], len(right))])
            totals = np.concatenate([totals, *of_right.values()])
        who, other = pa.array(who), pa.array(other)
        return pa.table({"id": table.column("id").take(who), "own": table.column("cluster").take(who),
                         "other": table.column("cluster").take(other), "total": totals})

    sums = (pairs.groupBy("low", "high").applyInArrow(tile, f"id {key_type}, own bigint, other bigint, total double")
            .groupBy("id", "own", "other").agg(F.sum("total").alias("total")))
    sizes = points.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("size"))
    near = join_on(sums, sizes, ["other"]).withColumn("same", F.col("own") == F.col("other"))
    per_point = near.groupBy("id").agg(
        F.max(F.when(F.col("same"), F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~F.col("same"), F.col("total") / F.col("size"))).alias("b"))
    # a point alone in its cluster counts 0
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per_point.agg(F.avg(value).alias("silhouette"))


def silhouette_squared(df: DataFrame, cluster: str, point: str) -> DataFrame:
    """One row: mean silhouette by squared Euclidean distance, which needs only sums per cluster:
    the mean squared distance to a cluster is |x|^2 - 2 x.mean + mean(|y|^2)."""
    points = df.select(F.col(cluster).cast("bigint").alias("own"), F.col(point).cast("array<double>").alias("point"))
    points = points.withColumn("sq", F.expr("aggregate(point, 0D, (s, x) -> s + x * x)"))
    totals = points.groupBy(F.col("own").alias("cluster")).agg(F.count("*").alias("n"), F.avg("sq").alias("msq"))
    per_cluster = join_on(totals, cluster_means(points, "own", "point"), ["cluster"])
    held = per_cluster.select(F.collect_list(F.struct("cluster", "n", "msq", "centre")).alias("h")).scalar()
    mean_to = F.expr("transform(__h, c -> named_struct('cluster', c.cluster, 'n', c.n, 'd', greatest(sq + c.msq - 2D * "
                     "aggregate(zip_with(point, c.centre, (a, b) -> a * b), 0D, (s, x) -> s + x), 0D)))")
    near = points.withColumn("__h", held).withColumn("__d", mean_to)
    a = F.expr("aggregate(filter(__d, c -> c.cluster = own), cast(null as double), (s, c) -> try_divide(c.d * c.n, c.n - 1))")
    b = F.expr("array_min(transform(filter(__d, c -> c.cluster != own), c -> c.d))")
    scored = near.select(a.alias("a"), b.alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return scored.agg(F.avg(value).alias("silhouette_squared"))


# ---- choice of k -------------------------------------------------------------------------------

def knee(costs: DataFrame, k: str = "k", cost: str = "cost", by=()) -> DataFrame:
    """(by, knee): the k at the knee of a convex, falling curve; NULL when there is none.

    The method of Satopaa et al. (2011): scale both axes to 0..1, take the gap between the curve and
    the diagonal, and accept the first local maximum after which the gap falls below the maximum less
    the mean step of k, before the next maximum. The table has one row per candidate k.
    """
    by = list(by)
    whole = Window.partitionBy(*by)
    order = whole.orderBy("x")
    x, y = F.col(k).cast("double"), F.col(cost).cast("double")

    def scaled(v):
        low, high = F.min(v).over(whole), F.max(v).over(whole)
        return F.try_divide(v - low, high - low)

    t = costs.select(*by, F.col(k).alias("k"), scaled(x).alias("x"), scaled(y).alias("y"))
    t = t.withColumn("gap", 1.0 - (F.col("x") + F.col("y")))
    t = t.withColumns({"before": F.lag("gap").over(order), "after": F.lead("gap").over(order),
                       "step": F.try_divide(F.max("x").over(whole) - F.min("x").over(whole), F.count("*").over(whole) - 1)})
    t = t.withColumn("peak", F.coalesce((F.col("gap") > F.col("before")) & (F.col("gap") > F.col("after")), F.lit(False)))
    t = t.withColumn("part", F.sum(F.col("peak").cast("int")).over(order))
    parts = t.where("part > 0").groupBy(*by, "part").agg(
        F.max(F.when(F.col("peak"), F.col("k"))).alias("k"),
        F.max(F.when(F.col("peak"), F.col("gap") - F.col("step"))).alias("limit"),
        F.min(F.when(~F.col("peak"), F.col("gap"))).alias("lowest"))
    found = parts.groupBy(*by).agg(F.min(F.when(F.col("lowest") < F.col("limit"), F.col("k"))).alias("knee"))
    if not by:
        return found
    return join_on(costs.select(*by).distinct(), found, by, "left")


def choose_k(models: dict, costs: DataFrame):
    """(k, model) at the knee, or (None, None)."""
    k = knee(costs).first()["knee"]
    return (k, models[k]) if k is not None else (None, None)


# ---- assignment and reports --------------------------------------------------------------------

def predict(model: Clusters, df: DataFrame, id_col: str, features=None) -> DataFrame:
    """(id, cluster). The id rides along, so nothing is matched by position."""
    if id_col not in df.columns:
        raise ValueError(f"no id column {id_col!r}: rows have no position to match them by")
    return model.transform(vectors(df, features, id_col)).select(id_col, "cluster")


def join_predictions(predictions: DataFrame, data: DataFrame, id_col: str, order=()) -> DataFrame:
    """Predictions with their data, one row per id: both sides keep the first row of an id before the join,
    so repeated ids cannot multiply."""
    if id_col not in data.columns:
        raise ValueError(f"no id column {id_col!r}: rows have no position to match them by")
    return join_on(first_per_key(predictions, [id_col], []), first_per_key(data, [id_col], order), [id_col])


def cluster_report(predictions: DataFrame, data: DataFrame, id_col: str, order=()):
    """(detail, summary): the joined rows; count, share and mean of every numeric column per cluster."""
    detail = join_predictions(predictions, data, id_col, order)
    numeric = [f.name for f in detail.schema if isinstance(f.dataType, NumericType) and f.name not in (id_col, "cluster")]
    summary = detail.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_count"), *[F.avg(c).alias(c) for c in numeric])
    # Fixed value: the name of the output column.
    return detail, with_share(summary, "cluster_count", "cluster_precentage")


def model_report(model: Clusters, n_features: int, n_samples: int, spark: SparkSession, id_col: str | None = None,
                 bucket: str | None = None, folder: str | None = None) -> DataFrame:
    """One row describing a trained model, to be appended to a report table."""
    row = (bucket, folder, len(model.clusterCenters()), n_features, n_samples, id_col, float(model.summary.trainingCost))
    return spark.createDataFrame([row], "model_bucket string, cloud_dir string, model_clusters int, num_training_features int, "
                                        "num_training_samples bigint, id_col string, model_inertia double")
