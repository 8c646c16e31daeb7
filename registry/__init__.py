"""Registered queries and the SQL each is checked against."""

from registry.base import ORACLES, QUERIES  # noqa: F401
from registry import io, metrics, models, prep, raster  # noqa: F401
