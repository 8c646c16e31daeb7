"""Date expressions."""

from pyspark.sql import Column, functions as F


def day_fraction(d) -> Column:
    """Day of the year over 365."""
    return F.dayofyear(F.col(d) if isinstance(d, str) else d) / 365.0


def image_date(d="date") -> Column:
    """Date of a ``yyyymmdd`` string."""
    return F.to_date(F.col(d) if isinstance(d, str) else d, "yyyyMMdd")
