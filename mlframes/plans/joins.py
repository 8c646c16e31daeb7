"""Joins of a big table with one row per key."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType

BROADCAST_ROWS = 100_000
SALTS = 8


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on named keys where NULL matches NULL; keeps the keys of the left side."""
    names = {k: f"__{k}" for k in keys}
    on = F.lit(True)
    for k, other in names.items():
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{other}`"))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def join_shuffled(left: DataFrame, right: DataFrame, keys, how: str = "inner", hint: str = "merge") -> DataFrame:
    """``join_on`` without a broadcast, for tables that grow with the input. Spark takes a table made by exploding a few
    rows for as small as those rows, and would gather it in the driver to broadcast it."""
    return join_on(left, right.hint(hint), keys, how)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def salt(df: DataFrame, salts: int = SALTS):
    """Salt number of each row, from a hash of the row."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")


def attach(big: DataFrame, per_key: DataFrame, keys, how: str = "left", salts: int = SALTS, hint: str = "merge") -> DataFrame:
    """Join values of each key to the rows of a big table; a hot key spreads over ``salts`` tasks.

    NULL keys match NULL keys. ``per_key`` is repeated ``salts`` times, so it should be the smaller side. It is never
    broadcast; with the hint ``shuffle_hash`` the big table is not sorted, and a task holds its part of ``per_key``.
    """
    keys = list(keys)
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_shuffled(big.withColumn("__salt", salt(big, salts)), right, [*keys, "__salt"], how, hint).drop("__salt")


def attach_small(big: DataFrame, lookup: DataFrame, keys, how: str = "left",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """``attach`` for a lookup table that is cheap to count: broadcast when it is small, salted beyond."""
    if at_most(lookup, limit):
        return join_on(big, F.broadcast(lookup), keys, how)
    return attach(big, lookup, keys, how)
