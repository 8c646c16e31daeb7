"""Pixel tables (filename, row, col, blue, green, red, nir[, rededge][, segment]) to features.

A pixel table is complete: it has a row for every pixel of an image. The segment column takes the
place of masks and pixel lists. ``filename`` and ``segment`` are never NULL, so joins on them are plain
equalities: two tables grouped by the segment are joined where they lie, without another shuffle.
"""

from pyspark.sql import DataFrame

KEYS = ["filename", "segment"]


def join_keyed(left: DataFrame, right: DataFrame, keys=KEYS, how: str = "inner") -> DataFrame:
    """Inner or left join on the keys, always shuffled: both sides grow with the images, and Spark's estimate of exploded
    pixels is so low that it would broadcast them through the driver."""
    return left.join(right.hint("merge"), list(keys), how)
