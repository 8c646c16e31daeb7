"""Column expressions over arrays that every operator of DataFrame functions here needs."""

from pyspark.sql import functions as F


def let(value, body):
    """``body(x)`` with ``value`` computed once, however often the body uses it, also within other lambdas."""
    return F.transform(F.array(value), body)[0]


def running_sums(values, block: int = 256):
    """Sums before each element of an array of longs. Blocks keep the appending linear in the array's length for all
    lengths that occur: each element copies at most a block."""
    def follow(x, start):
        grown = F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return F.slice(grown, 1, F.size(x))

    def total(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v)

    def sums(x):
        starts = F.sequence(F.lit(1), F.size(x), F.lit(block))
        return let(F.transform(starts, lambda s: F.slice(x, s, F.lit(block))), lambda blocks: F.flatten(F.zip_with(
            blocks, follow(F.transform(blocks, total), F.lit(0).cast("long")), follow)))

    return let(values, lambda x: F.when(F.size(x) > 0, sums(x)).otherwise(F.array().cast("array<long>")))
