"""First rows, shares, running totals and dense codes without one-task windows over data."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from mlframes.plans.joins import BROADCAST_ROWS, at_most, join_on
from mlframes.plans.storage import checkpoint

BUCKETS = 100


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of each key by ``order``, then by the other columns.

    An aggregate keeps one row per key and map task, so a hot key never gathers in one task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    by = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(f"`{c}`") for c in rest]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    return (df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(row, by).alias("__row"))
            .select(*[F.col(f"`{k}`") for k in keys], *[F.col("__row")[c].alias(c) for c in rest])
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def with_share(df: DataFrame, value: str, name: str, by=()) -> DataFrame:
    """Add each row's share of the total, over all rows or within ``by``."""
    by = list(by)
    if not by:
        total = df.select(F.sum(F.col(value).cast("double"))).scalar()
        return df.withColumn(name, F.try_divide(F.col(value).cast("double"), total))
    totals = df.groupBy(*by).agg(F.sum(F.col(value).cast("double")).alias("__total"))
    return (join_on(df, totals, by)
            .withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("__total"))).drop("__total"))


def _bucket(value: str) -> Column:
    """How many of the sorted ``__bounds`` lie below the value: first among every tenth, then among ten."""
    step = "(size(filter(__coarse, b -> b < {v})) * 10)".format(v=value)
    return F.expr(f"{step} + size(filter(slice(__bounds, {step} + 1, 10), b -> b < {value}))")


def running_totals(hist: DataFrame, keys, value: str, counts) -> DataFrame:
    """Add ``<count>_before``, the sum over the smaller values of the same key, and ``<count>_total``.

    ``hist`` has one row per (keys, value) with a numeric value. Values are cut into about a hundred
    ranges per key by approximate percentiles (a bounded sketch). Totals of the ranges are summed
    per key, and the running sum runs inside one range at a time, so no task sees a whole key.
    The result is exact: the sketch only decides where the ranges are cut.
    """
    keys, counts = list(keys), list(counts)
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = hist.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("__bounds"))
    bounds = bounds.withColumn("__coarse", F.expr("filter(__bounds, (b, i) -> i % 10 = 9)"))
    if keys:
        cut = join_on(hist, F.broadcast(bounds) if at_most(bounds, 10_000) else bounds, keys)
    else:
        held = bounds.select(F.struct("__bounds", "__coarse")).scalar()
        cut = hist.withColumn("__held", held).select("*", "__held.*").drop("__held")
    cut = cut.withColumn("__bucket", _bucket(f"`{value}`")).drop("__bounds", "__coarse")
    per_bucket = cut.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "__bucket",
        *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}_off") for c in counts],
        *[F.sum(f"__{c}").over(whole).alias(f"{c}_total") for c in counts])
    inside = (Window.partitionBy(*keys, "__bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = join_on(cut, offsets, [*keys, "__bucket"])
    out = out.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{c}_off")
                           for c in counts})
    return out.drop("__bucket", *[f"__{c}_off" for c in counts])


def dense_codes(values: DataFrame, column: str, name: str = "code", limit: int = BROADCAST_ROWS) -> DataFrame:
    """0-based rank of sorted distinct values. ``values`` must hold each value once, without NULL.

    Up to ``limit`` values one window is enough. Beyond, the values are range-partitioned and written out
    with their range, so that a lost task cannot cut them differently, and ranked range by range.
    """
    if at_most(values, limit):
        return values.withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))
    ranged = checkpoint(values.repartitionByRange(column).withColumn("__bucket", F.spark_partition_id()))
    sizes = ranged.groupBy("__bucket").agg(F.count("*").alias("__n"))  # one row per range
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(
        Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__bucket").orderBy(column)
    return (ranged.join(F.broadcast(offsets), "__bucket")
            .withColumn(name, (F.col("__off") + F.row_number().over(inside) - 1).cast("bigint"))
            .drop("__bucket", "__off"))
