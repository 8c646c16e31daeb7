"""Reproducible pseudo-random numbers: md5 of (seed, key), the same in any engine."""

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits: the largest whole number of hex digits a double holds exactly


def md5_key(seed: int, *keys) -> Column:
    parts = [F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("\\N"))
             for k in keys]
    return F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}:"), parts[0]), *parts[1:]))


def hash52(seed: int, *keys) -> Column:
    """Integer in [0, 2**52)."""
    return F.conv(F.substring(md5_key(seed, *keys), 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(seed: int, *keys) -> Column:
    """Double in [0, 1)."""
    return hash52(seed, *keys) / F.lit(float(2 ** 52))
