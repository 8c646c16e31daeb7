"""Approximate nearest neighbours by cross-polytope hashing: pseudo-rotations, multiprobe tables, exact reranking."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from mlframes.llm.common import column, saved

#: Tables, buckets each query looks into in a table, and pseudo-rotations that name a bucket.
TABLES, PROBES, HASHES = 16, 12, 1
#: Vectors, and queries, of a bucket that are compared in one task.
CHUNK = 4096
#: Norms within a factor of ``BAND`` share tables; a band of no more than ``SMALL`` distinct vectors is one bucket.
BAND, SMALL = 1.25, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows times the Hadamard matrix of their length, a power of two, in n log n steps."""
    rows, n = x.shape
    step = 1
    while step < n:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed) -> np.ndarray:
    """Rows turned by three rounds of random signs and a Hadamard transform: nearly a random rotation."""
    for signs in np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1])):
        x = hadamard(x * signs)
    return x


def placed(vectors: np.ndarray) -> np.ndarray:
    """The directions of vectors, padded to a power of two."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    width = 2
    while width < unit.shape[1]:
        width *= 2
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def buckets(unit: np.ndarray, table: int, probes: int, hashes: int, seed: int) -> np.ndarray:
    """Numbers of the buckets of each row, nearest first: the signed axes that the rotated vector is nearest to,
    one for each rotation; further probes trade the axis that loses least."""
    n, width = unit.shape
    best = np.zeros((n, 1), np.int64)
    lost = np.zeros((n, 1))
    for h in range(hashes):
        y = rotated(unit, (seed, table, h, width))
        both = np.concatenate([y, -y], axis=1)
        few = min(probes, 2 * width)
        axes = np.argsort(-both, axis=1, kind="stable")[:, :few]
        near = np.take_along_axis(both, axes, axis=1)
        gap = (near[:, :1] - near) ** 2
        codes = (best[:, :, None] * (2 * width) + axes[:, None, :]).reshape(n, -1)
        lost = (lost[:, :, None] + gap[:, None, :]).reshape(n, -1)
        order = np.argsort(lost, axis=1, kind="stable")[:, :probes]
        best, lost = np.take_along_axis(codes, order, axis=1), np.take_along_axis(lost, order, axis=1)
    return best


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _hash(bands: dict, tables: int, probes: int, hashes: int, seed: int, query: bool):
    """Rows (k1, k2, dim, tab, bucket) of distinct vectors (k1, k2, vec, and band or nothing). ``bands`` has the number
    and the count of each length's bands; a query looks into all of its length, a vector is in its own."""
    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(2)))
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                own = None if query else part.column(3).to_numpy(zero_copy_only=False)
                rest = part.columns[2:3] if query else [part.column(2), part.column(4)]
                names = ["k1", "k2", "dim", "tab", "bucket", "vec", "ids"][:5 + len(rest)]

                def sent(rows, tab, found):
                    again = pa.array(np.repeat(rows, found.shape[1]))
                    return pa.RecordBatch.from_arrays(
                        [part.column(0).take(again), part.column(1).take(again), pa.array(np.full(len(again), dim, np.int32)),
                         pa.array(np.full(len(again), tab, np.int32)), pa.array(found.ravel()), *(c.take(again) for c in rest)], names=names)
                large = []
                for band, (number, count) in bands[int(dim)].items():
                    rows = np.arange(part.num_rows) if query else np.flatnonzero(own == band)
                    if count > SMALL:
                        large.append((rows, number))
                    elif len(rows):
                        yield sent(rows, number * tables, np.full((len(rows), 1), -1))
                unit = placed(_matrix(part.column(2))) if large else None
                for table in range(tables if large else 0):
                    found = buckets(unit, table, probes if query else 1, hashes, seed)
                    for rows, number in large:
                        yield sent(rows, number * tables + table, found[rows])
    return run


def _nearest(top: int):
    """Of one chunk of vectors and one of queries: each query's best ids and exact scores."""
    schema = "k1 long, k2 int, ids array<long>, scores array<double>"

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"k1": [], "k2": [], "ids": [], "scores": []}
        if index.num_rows and queries.num_rows:
            vectors, asked = _matrix(index.column("vec")), _matrix(queries.column("vec"))
            owners = index.column("ids").to_pylist()
            rough = asked @ vectors.T
            few = min(top, rough.shape[1])
            last = -np.partition(-rough, few - 1, axis=1)[:, few - 1] if few else np.zeros(len(asked))
            # no rough score is further off than this, so all that may be among the best, ties too, are scored exactly
            off = 4e-16 * vectors.shape[1] * np.abs(vectors).max() * np.abs(asked).sum(axis=1)
            for k1, k2, ask, near, least in zip(queries.column("k1").to_pylist(), queries.column("k2").to_pylist(), asked, rough, last - 2 * off):
                pick = np.flatnonzero(near >= least)
                exact = (ask * vectors[pick]).sum(axis=1)
                found = sorted((-s, i) for p, s in zip(pick.tolist(), exact.tolist()) for i in owners[p])[:top]
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["ids"].append([i for _, i in found])
                out["scores"].append([-s for s, _ in found])
        return pa.table([pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int32()), pa.array(out["ids"], pa.list_(pa.int64())),
                         pa.array(out["scores"], pa.list_(pa.float64()))], names=list(out))
    return run, schema


def _merge(top: int):
    """The best of all chunks, from rows sorted by query; a task holds one query's best at a time."""
    def best(ids, scores):
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:top]
        return ids[first], scores[first]

    def run(batches):
        now, ids, scores = None, [], []
        names = ["k1", "k2", "ids", "scores"]

        def row():
            i, s = best(ids, scores)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()),
                                               pa.array([i], pa.list_(pa.int64())), pa.array([s], pa.list_(pa.float64()))], names=names)
        for batch in batches:
            for k1, k2, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (k1, k2) != now:
                    if now:
                        yield row()
                    now, ids, scores = (k1, k2), [], []
                ids.append(i.values.to_numpy(zero_copy_only=False))
                scores.append(s.values.to_numpy(zero_copy_only=False))
                if len(ids) >= 256:
                    i, s = best(ids, scores)
                    ids, scores = [i], [s]
        if now:
            yield row()
    return run


def _scored(index: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """The best of each query (k1, k2, ids, scores) among the vectors in buckets that it looks into."""
    key = ["dim", "tab", "bucket"]
    sizes = (index.groupBy(*key).agg(F.count("*").alias("n"))
             .join(asked.groupBy(*key).agg(F.count("*").alias("m")), key)
             .select(*key, F.ceil(F.col("n") / CHUNK).cast("int").alias("cn"), F.ceil(F.col("m") / CHUNK).cast("int").alias("cm")))

    def chunked(df, own, other, a, b):
        df = df.join(sizes, key).withColumn(a, F.pmod(F.col("k2"), F.col(own)))
        return df.withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("cn", "cm")

    group = [*key, "i", "q"]
    run, schema = _nearest(top)
    found = (chunked(index, "cn", "cm", "i", "q").groupBy(*group)
             .cogroup(chunked(asked, "cm", "cn", "q", "i").groupBy(*group)).applyInArrow(lambda a, b: run(a, b), schema))
    return found.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_merge(top), schema)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20,
            tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds the ``top`` other rows found with the
    largest inner product, in double precision, ties to the smaller id.

    Vectors are dealt into bands of norm, so that within one the inner product follows the angle. Every vector is in a
    bucket of each of its band's ``tables`` tables, named by the signed axis nearest to it after a pseudo-rotation
    (``hashes`` of them); a query looks into ``probes`` buckets of each table of every band and all it finds there is
    scored exactly. A band of few vectors is one bucket. Queries that find fewer than ``top`` rows there, and fewer than
    there are, are compared with all vectors, in chunks. More hashes make finer buckets for larger tables, more probes and tables a higher recall.
    Equal vectors are hashed once, with their smallest ids, of which no more than ``top`` + 1 can be in a
    result; buckets are compared in chunks of ``CHUNK`` vectors and queries, so a full one is many small tasks.

    Vectors that are null, empty, zero, or hold a null or non-finite number take no part, nor do null ids. Rows equal in
    id and vector are one. Vectors only meet those of their own length.
    """
    vec = column(vector_col)
    fine = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.where(fine & column(id_col).isNotNull()).select(
        column(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.xxhash64(vec).alias("k1"), F.hash(vec).alias("k2")).distinct()
    most = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    norm = F.log("most") + F.log(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(x / F.col("most"), F.lit(2.0)))) / 2
    band = F.floor(norm / math.log(BAND) + 0.5).cast("int")  # norms near 1 are not near an edge
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    index = (rows.withColumn("place", place).where(F.col("place") <= top + 1)
             .groupBy("k1", "k2").agg(F.min("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.where("asks").groupBy("k1", "k2").agg(F.min("vec").alias("vec"))
    kind = index.schema["vec"].dataType.simpleString()
    head = "k1 long, k2 int, dim int, tab int, bucket long"
    index = index.withColumn("most", most).select("k1", "k2", "vec", band.alias("band"), "ids")
    single, queries, bands = saved(index, "vectors"), asked, {}
    for number, (dim, b, n) in enumerate(single.groupBy(F.size("vec"), "band").count().collect()):
        bands.setdefault(dim, {})[b] = number, n
    index = saved(single.mapInArrow(_hash(bands, tables, probes, hashes, seed, False), f"{head}, vec {kind}, ids array<long>"), "index")
    asked = saved(asked.mapInArrow(_hash(bands, tables, probes, hashes, seed, True), f"{head}, vec {kind}"), "probes")
    best = saved(_scored(index, asked, top + 1), "best")
    # queries whose buckets held too few vectors are compared with all of their length
    everything = [F.size("vec").alias("dim"), F.lit(0).alias("tab"), F.lit(-1).cast("long").alias("bucket")]
    held = single.select(F.size("vec").alias("dim"), F.explode("ids").alias("id")).groupBy("dim").agg(F.countDistinct("id").alias("n"))
    short = saved(queries.withColumn("dim", F.size("vec")).join(best, ["k1", "k2"], "left").join(held, "dim")
                  .where(F.coalesce(F.size("ids"), F.lit(0)) < F.least(F.lit(top + 1), "n")).select("k1", "k2", "vec"), "short")
    if not short.isEmpty():
        exact = _scored(single.select("k1", "k2", *everything, "vec", "ids"), short.select("k1", "k2", *everything, "vec"), top + 1)
        best = best.join(short, ["k1", "k2"], "left_anti").unionByName(exact)
    each = rows.where("asks").select(F.col("id").alias("query_id"), "k1", "k2").join(best, ["k1", "k2"])
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    return (each.select("query_id", F.posexplode(F.slice(pairs, 1, top)))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score")))
