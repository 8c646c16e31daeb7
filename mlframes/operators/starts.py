"""K-means from many starts at once: every pass over the points moves the centres of all runs that are not settled."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.storagelevel import StorageLevel

#: Points that first centres are drawn from (k-means++), for each group; all points take part in every pass.
DRAWN = 2_000
#: Bytes of distances that a task holds at a time, and of centres that go to the tasks in one pass.
DISTANCE_BYTES, CENTRE_BYTES = 32 << 20, 64 << 20
#: Bytes of points in a row of a pass, and in a part at most.
BLOCK_BYTES, PART_BYTES = 256 << 10, 256 << 20


class Clusters:
    """Centres found by k-means, and their cost: the sum of squared distances to the nearest centre."""

    def __init__(self, centres: np.ndarray, cost: float):
        self.centres, self.cost = np.asarray(centres, float), float(cost)

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    @property
    def summary(self):
        return SimpleNamespace(trainingCost=self.cost, k=len(self.centres))

    def transform(self, df: DataFrame, features: str = "features", name: str = "cluster") -> DataFrame:
        """Add the nearest centre of a vector column."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(points: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(points.to_list()), centres).argmin(1).astype(np.int32) if len(points) else [], dtype="int32")

        return df.withColumn(name, nearest(vector_to_array(F.col(features))))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), self.cost) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cluster int, centre array<double>, cost double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Clusters":
        rows = spark.read.parquet(path).orderBy("cluster").collect()  # one row per centre
        return cls([r["centre"] for r in rows], rows[0]["cost"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the square of the point: enough to tell the nearest. Both sides move near the origin first."""
    middle = centres.mean(0)
    x, centres = x - middle, centres - middle
    return (centres * centres).sum(1) - 2 * x @ centres.T


def plus_plus(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres by k-means++: each next one with a chance by its squared distance to those before."""
    chosen = [points[rng.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = gap.sum()
        nxt = points[rng.choice(len(points), p=gap / total)] if total > 0 else points[rng.integers(len(points))]
        chosen.append(nxt)
        gap = np.minimum(gap, ((points - nxt) ** 2).sum(1))
    return np.array(chosen)


def drawn_points(points: DataFrame, group: str | None = None, rows: int = DRAWN) -> dict:
    """A bounded draw of points per group, by a hash of the point."""
    by = F.xxhash64("point")
    if group is None:
        picked = points.select("point").orderBy(by, "point").limit(rows)
        return {0: np.array([r["point"] for r in picked.collect()])}
    place = F.row_number().over(Window.partitionBy(group).orderBy(by, "point"))
    out = {}
    for r in points.select(group, "point").withColumn("__place", place).where(F.col("__place") <= rows).collect():
        out.setdefault(r[group], []).append(r["point"])
    return {g: np.array(p) for g, p in out.items()}


def _packed(points: DataFrame, width: int) -> DataFrame:
    """(group, block): up to ``BLOCK_BYTES`` of points of one group as doubles in one row, in about as many parts as there are
    cores. The passes read blocks as they are, and few parts keep the sums that each pass shuffles few."""
    def pack(batches):
        held = {}
        for batch in batches:
            groups = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for group in np.unique(groups):
                held.setdefault(int(group), []).append(flat[groups == group])
            full = [g for g, of in held.items() if sum(x.nbytes for x in of) >= BLOCK_BYTES]
            if not full and sum(x.nbytes for of in held.values() for x in of) >= 16 * BLOCK_BYTES:
                full = list(held)
            for group in full:
                yield from blocks(group, held.pop(group))
        for group, of in held.items():
            yield from blocks(group, of)

    def blocks(group, of):
        every, rows = np.concatenate(of), max(1, BLOCK_BYTES // (8 * width))
        for start in range(0, len(every), rows):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([every[start:start + rows].tobytes()], pa.binary())],
                                             names=["group", "block"])

    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-points.count() * width * 8 // PART_BYTES))
    return points.mapInArrow(pack, "group int, block binary").repartition(parts)


def _pass(blocks: DataFrame, runs: dict, costs: bool = False) -> dict:
    """One pass over packed points: run -> (points, sums of points) by centre, or its cost, for ``runs`` of (group, centres)."""
    by_group = {}
    for run, (group, centres) in runs.items():
        by_group.setdefault(group, []).append((run, centres))
    width = next(iter(runs.values()))[1].shape[1]
    firsts = {g: np.cumsum([0] + [len(c) for _, c in of]) for g, of in by_group.items()}
    stacked = {g: np.concatenate([c for _, c in of]) for g, of in by_group.items()}
    rows_held = {g: max(16, DISTANCE_BYTES // (8 * max(len(c), width if costs else 0))) for g, c in stacked.items()}

    def chunks(batches):
        for batch in batches:
            for group, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if group in by_group:
                    every = np.frombuffer(block.as_buffer(), float).reshape(-1, width)
                    for start in range(0, len(every), rows_held[group]):
                        x = every[start:start + rows_held[group]]
                        near, first = _nearest(x, stacked[group]), firsts[group]
                        yield group, x, [near[:, a:b].argmin(1) for a, b in zip(first[:-1], first[1:])]

    def added(batches):
        out = {g: (np.zeros(len(c)), np.zeros((len(c), width))) for g, c in stacked.items()}
        for group, x, own in chunks(batches):
            mark = np.zeros((len(x), len(stacked[group])))
            for place, first in zip(own, firsts[group]):
                mark[np.arange(len(x)), first + place] = 1
            n, sums = out[group]
            n += mark.sum(0)
            sums += mark.T @ x
        rows = [(run, i, n[first + i], sums[first + i].tolist()) for g, (n, sums) in out.items()
                for (run, c), first in zip(by_group[g], firsts[g]) for i in range(len(c)) if n[first + i]]
        for start in range(0, len(rows), 1024):
            run, i, n, sums = zip(*rows[start:start + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.float64()),
                                              pa.array(sums, pa.list_(pa.float64()))], names=["run", "centre", "n", "sums"])

    def paid(batches):
        total = dict.fromkeys(runs, 0.0)
        for group, x, own in chunks(batches):
            for (run, centres), place in zip(by_group[group], own):
                total[run] += ((x - centres[place]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["run", "cost"])

    if costs:
        found = blocks.mapInArrow(paid, "run int, cost double").groupBy("run").agg(F.sum("cost").alias("cost"))
        return {run: 0.0 for run in runs} | {r["run"]: r["cost"] for r in found.collect()}  # one row per run
    found = blocks.mapInArrow(added, "run int, centre int, n double, sums array<double>").groupBy("run", "centre").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    out = {run: (np.zeros(len(c)), np.zeros((len(c), width))) for run, (_, c) in runs.items()}
    for r in found.collect():  # one row per centre of every run
        n, sums = out[r["run"]]
        n[r["centre"]], sums[r["centre"]] = r["n"], r["sums"].toArray()
    return out


def settle(points: DataFrame, starts: list[tuple[int, np.ndarray]], max_iter: int, tol: float = 0.0) -> list[Clusters]:
    """The centres and cost that each start (group, centres) comes to. ``points`` has ``group`` (int) and ``point`` (array).

    A run is settled when the squares of its centres' moves add up to ``tol`` at most; it then leaves the passes. A centre
    without points stays where it is. Starts whose centres exceed ``CENTRE_BYTES`` together take turns.
    """
    done, waiting = {}, dict(enumerate(starts))
    blocks = _packed(points.select("group", "point"), starts[0][1].shape[1]).persist(StorageLevel.MEMORY_AND_DISK) if starts else None
    try:
        while waiting:
            held, now, ended = 0, {}, {}
            for run, (group, centres) in list(waiting.items()):
                if now and held + centres.nbytes > CENTRE_BYTES:
                    break
                held += centres.nbytes
                now[run] = waiting.pop(run)
            for step in range(max_iter + 1):
                if step == max_iter:
                    ended |= now
                    break
                for run, (n, sums) in _pass(blocks, now).items():
                    group, old = now[run]
                    new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
                    if ((new - old) ** 2).sum() <= tol:
                        ended[run] = now.pop(run)
                    else:
                        now[run] = group, new
                if not now:
                    break
            for run, cost in _pass(blocks, ended, costs=True).items():
                done[run] = Clusters(ended[run][1], cost)
    finally:
        if blocks is not None:
            blocks.unpersist()
    return [done[run] for run in range(len(starts))]


def best_of_starts(data: DataFrame, ks, n_init: int, max_iter: int, seed: int, tolerance: float = 1e-4) -> dict[int, Clusters]:
    """For each k the cheapest of ``n_init`` runs, all ks and runs in the same passes over a cached frame with ``features``.

    ``tolerance`` is a share of the mean variance of the features, as is usual for k-means.
    """
    points = data.select(F.lit(0).alias("group"), vector_to_array("features").alias("point"))
    variance = data.agg(Summarizer.variance(F.col("features"))).first()[0]
    pool = drawn_points(points, rows=max(DRAWN, 20 * max(ks)))[0]
    wanted = [(k, seed + i) for k in ks for i in range(n_init)]
    starts = [(0, plus_plus(pool, k, np.random.default_rng([s, k]))) for k, s in wanted]
    found = settle(points, starts, max_iter, tolerance * float(np.nan_to_num(variance.toArray()).mean()))
    return {k: min((c for (of, _), c in zip(wanted, found) if of == k), key=lambda c: c.cost) for k in ks}
