"""NaN and infinity become NULL, which Spark aggregates skip."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

INF = float("inf")


def replace_inf(c) -> Column:
    """Infinite values to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) != F.lit(INF), c)


def finite(c) -> Column:
    """NaN and infinite values to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floating})
