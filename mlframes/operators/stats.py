"""Tests, correlations, histograms, shares and straight-line fits."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from mlframes.functions.arrays import argmax_column
from mlframes.functions.bins import equal_width_bin
from mlframes.functions.nulls import clean
from mlframes.plans.joins import attach_small
from mlframes.plans.ranks import dense_codes, with_share


# ---- two-sample test ---------------------------------------------------------------------------

def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (Lentz), on arrays."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def two_sided_p(t, dof):
    """Two-sided p-value of Student's t, on arrays."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    x = dof / (dof + t * t)
    a, b = dof / 2, np.full_like(dof, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    with np.errstate(all="ignore"):
        low = front * _beta_fraction(a, b, x) / a
        high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return np.where(t == 0, 1.0, np.where(x < (a + 1) / (a + b + 2), low, high))


@F.pandas_udf(DoubleType())
def _p_value(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, dof in parts:
        ok = t.notna() & (dof > 0)
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = two_sided_p(t[ok], dof[ok])
        yield out.astype(object).where(out.notna(), None)


def ttest(df: DataFrame, feature: str, condition: str, by=(), p_value: bool = True) -> DataFrame:
    """Equal-variance two-sample t-test of rows where the condition holds against rows where it does not.

    One row (n1, n2, mean1, mean2, t, df, p) per ``by`` key from a single aggregation.
    """
    x, c = F.col(feature), F.col(condition)
    sides = {"1": F.when(c, x), "2": F.when(~c, x)}
    moments = [f(v).alias(name + s) for s, v in sides.items()
               for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    m = df.groupBy(*by).agg(*moments).withColumn("df", F.col("n1") + F.col("n2") - 2)
    pooled = F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("df"))
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2")))
    m = m.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), error))
    out = m.select(*by, "n1", "n2", "mean1", "mean2", "t", "df")
    return out.withColumn("p", _p_value("t", F.col("df").cast("double"))) if p_value else out


# ---- correlation -------------------------------------------------------------------------------

def correlations(df: DataFrame, features, digits: int | None = 2) -> DataFrame:
    """(feature_x, feature_y, corr): upper triangle with the diagonal, all pairs in one aggregation.

    A pair with a missing side is skipped for that pair only.
    """
    features = list(features)
    df = clean(df.select(*features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    both = {(a, b): F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs}
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(both.values())])
    value = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"), value(F.col(f"c{i}")).alias("corr"))
        for i, (a, b) in enumerate(pairs)])))


# ---- histograms --------------------------------------------------------------------------------

def shared_histogram(df: DataFrame, columns, edges: int, low: float = 0.0, high: float = 9000.0) -> DataFrame:
    """(bin, from_edge, to_edge, n_<column>...) on ``edges`` equally spaced edges, so ``edges - 1`` bins.

    Values outside the range are left out; the last bin includes its upper edge.
    """
    columns, bins = list(columns), edges - 1
    placed = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), equal_width_bin(c, low, high, bins).alias("bin")) for c in columns])))
    counts = placed.where("bin is not null").groupBy("bin").agg(
        *[F.count_if(F.col("column") == c).alias(f"n_{c}") for c in columns])
    # at most `bins` rows are left: hold them in one row to add the empty bins
    held = counts.agg(F.collect_list(F.struct(*counts.columns)).alias("held"))
    grid = held.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "held")
    width = (high - low) / bins

    def n(c):
        mine = F.filter("held", lambda h: h["bin"] == F.col("bin"))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, h: a + h[f"n_{c}"]).alias(f"n_{c}")

    return grid.select("bin", (F.col("bin") * width + low).alias("from_edge"),
                       ((F.col("bin") + 1) * width + low).alias("to_edge"), *[n(c) for c in columns])


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(bx, by, n) over ``bins`` x ``bins`` cells between the smallest and largest value of each axis."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = df.select(F.struct(*[f(c).cast("double").alias(f"{name}_{c}") for c in (x, y)
                                for name, f in (("min", F.min), ("max", F.max))])).scalar()
    placed = df.select(*[equal_width_bin(F.col(c).cast("double"), ends[f"min_{c}"], ends[f"max_{c}"], bins).alias(b)
                         for c, b in ((x, "bx"), (y, "by"))])
    counts = placed.groupBy("bx", "by").agg(F.count("*").alias("n"))
    held = counts.agg(F.collect_list(F.struct("bx", "by", "n")).alias("held"))
    side = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = (held.select(F.explode(side).alias("bx"), "held")
            .select("bx", F.explode(side).alias("by"), "held"))
    mine = F.filter("held", lambda h: (h["bx"] == F.col("bx")) & (h["by"] == F.col("by")))
    return grid.select("bx", "by", F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, h: a + h["n"]).alias("n"))


# ---- shares ------------------------------------------------------------------------------------

def category_shares(df: DataFrame, column: str, split: str = "split", first: str = "Train",
                    second: str = "Test") -> DataFrame:
    """(category, share_first, share_second) of two parts of one table; one scan."""
    counts = (df.where(F.col(column).isNotNull() & F.col(split).isin(first, second))
              .groupBy(split, F.col(column).alias("category")).agg(F.count("*").alias("n")))
    shares = with_share(counts, "n", "share", [split])
    return shares.groupBy("category").agg(*[
        F.max(F.when(F.col(split) == part, F.col("share"))).alias(name)
        for part, name in ((first, "share_first"), (second, "share_second"))])


def compare_category_shares(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """The same for two tables: category shares side by side, matched on the category."""
    def shares(df, name):
        counts = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category"))
                  .agg(F.count("*").alias("n")))
        return with_share(counts, "n", name).drop("n")

    return shares(first, "share_first").join(shares(second, "share_second"), "category", "full_outer")


# ---- straight lines ----------------------------------------------------------------------------

def fit_line(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """(intercept, slope) of y on x."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(F.regr_intercept(a, b).alias("intercept"), F.regr_slope(a, b).alias("slope"))


# Cumulative probabilities of a Poisson count with mean 1.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(16)]


def _poisson(rows: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A Poisson count for every row and replicate, from a hash of both (the finaliser of SplitMix64)."""
    x = rows[:, None] + replicates[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53
    return np.searchsorted(POISSON_CDF, u, "right").astype(float)


def fit_band(df: DataFrame, x: str, y: str, key, ci: float = 80.0, points: int = 100, replicates: int = 1000,
             seed: int = 42) -> DataFrame:
    """(x, fit, low, high): bootstrap confidence band of the fitted line on a grid over x.

    Every row takes part in every replicate with a Poisson weight from a hash of its key. A task adds weighted sums of the
    deviations from the means, which large values do not cancel, and only one row per task and replicate is shuffled.
    Rows that share a key share their weights, so a key should tell rows apart, or name groups to draw together.
    """
    keys = [key] if isinstance(key, str) else list(key)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    kept = df.where(a.isNotNull() & b.isNotNull()).select(F.xxhash64(F.lit(seed), *keys).alias("row"), a.alias("x"), b.alias("y"))
    mean_x, mean_y, low, high = kept.agg(F.avg("x"), F.avg("y"), F.min("x"), F.max("x")).first()
    names = ["n", "sx", "sy", "sxx", "sxy"]

    def added(batches):
        number = np.arange(1, replicates + 1, dtype=np.uint64)
        sums = np.zeros((replicates + 1, len(names)))  # 0: the fit itself
        for batch in batches:
            row, dx, dy = (c.to_numpy() for c in batch.columns)
            dx, dy = dx - mean_x, dy - mean_y
            values = np.column_stack([np.ones(len(dx)), dx, dy, dx * dx, dx * dy])
            sums[0] += values.sum(0)
            for start in range(0, len(dx), 1024):
                weights = _poisson(row[start:start + 1024].view(np.uint64), number)
                sums[1:] += weights.T @ values[start:start + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1)), *[pa.array(c) for c in sums.T.copy()]], names=["replicate", *names])

    parts = kept.mapInArrow(added, "replicate bigint, " + ", ".join(f"{c} double" for c in names))
    fits = parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")
    # each replicate's own means are near the overall ones, so this last step cancels little
    slope = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    fits = fits.withColumn("slope", slope).withColumn("level", F.lit(mean_y) + (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    at = F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("i") / (points - 1)
    grid = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", at)
    at = F.col("level") + F.col("slope") * (F.col("x") - F.lit(mean_x))
    side = (100.0 - ci) / 200.0
    resampled = F.when(F.col("replicate") > 0, at)
    return grid.groupBy("i").agg(
        F.max("x").alias("x"), F.max(F.when(F.col("replicate") == 0, at)).alias("fit"),
        F.percentile(resampled, side).alias("low"), F.percentile(resampled, 1 - side).alias("high")).drop("i")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, position, y, trend): straight line of y over the 0-based position of the sorted categories."""
    positions = dense_codes(df.select(x).where(F.col(x).isNotNull()).distinct(), x, "position")
    placed = attach_small(df.select(x, y), positions, [x], "inner")
    line = placed.select(F.struct(F.regr_intercept(y, "position").alias("a"),
                                  F.regr_slope(y, "position").alias("b"))).scalar()
    return placed.select(x, "position", y, (line["a"] + line["b"] * F.col("position")).alias("trend"))


def actual_versus_predicted(df: DataFrame, actual: str, predicted: str, label, low: float = 0,
                            high: float = 12_000) -> DataFrame:
    """(actual, predicted, label, fitted): chart table with the fitted line over all points.

    ``label`` is a column, or several indicator columns whose largest one names the label.
    """
    name = F.col(label) if isinstance(label, str) else argmax_column(label)
    line = fit_line(df, actual, predicted).select(F.struct("intercept", "slope")).scalar()
    shown = df.where(F.col(actual).between(low, high) & F.col(predicted).between(low, high))
    return shown.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), name.alias("label"),
                        (line["intercept"] + line["slope"] * F.col(actual)).alias("fitted"))
