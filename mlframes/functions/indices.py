"""Vegetation and water indices from four bands. Undefined values are NULL."""

from pyspark.sql import Column, functions as F

BANDS = ["blue", "green", "red", "nir"]


def _ratio(a, b) -> Column:
    return F.try_divide(a, b)


def _bands():
    return tuple(F.col(b).cast("double") for b in BANDS)


def ndvi_r() -> Column:
    _, _, r, n = _bands()
    return _ratio(n - r, n + r)


def ndvi_g() -> Column:
    _, g, _, n = _bands()
    return _ratio(n - g, n + g)


def ndvi_b() -> Column:
    b, _, _, n = _bands()
    return _ratio(n - b, n + b)


def ndwi() -> Column:
    _, g, _, n = _bands()
    return _ratio(g - n, g + n)


def evi() -> Column:
    b, _, r, n = _bands()
    return _ratio(n - r, n + 6.0 * r - 7.5 * b + 1.0) * 2.5


def savi() -> Column:
    _, _, r, n = _bands()
    return _ratio(n - r, n + r + 0.5) * 1.5


def msavi() -> Column:
    _, _, r, n = _bands()
    root = (2.0 * n + 1.0) * (2.0 * n + 1.0) - 8.0 * (n - r)
    return (2.0 * n + 1.0 - F.sqrt(F.when(root >= 0, root))) / 2.0


INDICES = {"NDVI_r": ndvi_r, "NDVI_g": ndvi_g, "NDVI_b": ndvi_b, "EVI": evi,
           "SAVI": savi, "MSAVI": msavi, "NDWI": ndwi}


def with_indices(df):
    """Add the seven index columns to a pixel table."""
    return df.withColumns({name: make() for name, make in INDICES.items()})


def simple_ratio(nir, red) -> Column:
    return _ratio(nir, red + 1.0)


def enhanced_ratio(nir, red, blue) -> Column:
    """The pixel form of EVI whose added one stands outside the denominator."""
    return (_ratio(nir - red, 1.0 + nir + 6.0 * red - 7.5 * blue) + 1.0) * 2.5


def chlorophyll(nir, band) -> Column:
    """Chlorophyll ratio for the green or the red-edge band."""
    return _ratio(nir, band + 1.0) - 1.0


def mtci(nir, rededge, red) -> Column:
    return _ratio(nir - rededge, (rededge - red) + 1.0)


def red_green_over_blue() -> Column:
    b, g, r, _ = _bands()
    return _ratio(r - g, b)


def plain_gray() -> Column:
    b, g, r, _ = _bands()
    return (r + g + b) / 3.0
