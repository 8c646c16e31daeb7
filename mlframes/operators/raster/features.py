"""Statistics of bands, indices and colours per segment and per image."""

from pyspark.sql import DataFrame, functions as F

from mlframes.functions import colour, indices
from mlframes.functions.dates import day_fraction, image_date
from mlframes.operators.raster import KEYS, join_keyed
from mlframes.plans.joins import attach
from mlframes.plans.quantiles import GROUP_ROWS, grouped_interquartile_means, grouped_quantiles, ranks_within

# The quantities described per segment, and the statistics of each.
QUANTITIES = ["red", "blue", "green", "nir", "SAVI", "NDVI_b", "NDVI_g", "NDVI_r", "EVI", "MSAVI", "NDWI"]
STATISTICS = ["min", "max", "std", "mean", "median"]


def segment_pixels(px: DataFrame) -> DataFrame:
    """(filename, segment, n): the segments of each image."""
    return px.groupBy(*KEYS).agg(F.count("*").alias("n"))


def index_features(px: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """55 columns ``<quantity>_<statistic>`` per segment. NULL pixels are skipped.

    Simple statistics combine before the shuffle; medians take the size-checked path of
    ``grouped_quantiles``, which moves the four bands and works the indices out where they are sorted. Both are partitioned by the segment, so joining them moves nothing.
    """
    def quantities(bands: DataFrame) -> DataFrame:
        return indices.with_indices(bands).select(*KEYS, *[F.col(q).cast("double").alias(q) for q in QUANTITIES])

    px = px.select(*KEYS, *indices.BANDS)
    values = quantities(px)
    simple = {"min": F.min, "max": F.max, "std": F.stddev_pop, "mean": F.avg}
    basic = values.groupBy(*KEYS).agg(*[f(q).alias(f"{q}_{s}") for q in QUANTITIES for s, f in simple.items()])
    medians = grouped_quantiles(px, KEYS, QUANTITIES, [0.5], group_rows, quantities)
    medians = medians.withColumnsRenamed({f"{q}_q0": f"{q}_median" for q in QUANTITIES})
    return join_keyed(basic, medians, KEYS).select(*KEYS, *[f"{q}_{s}" for q in QUANTITIES for s in STATISTICS])


def colourfulness(px: DataFrame, keys, name: str, legacy_green: bool = False) -> DataFrame:
    """Colourfulness by the opponent-colour formula; ``legacy_green`` reads blue in place of green."""
    b, r = F.col("blue").cast("double"), F.col("red").cast("double")
    g = b if legacy_green else F.col("green").cast("double")
    rg, yb = F.abs(r - g), F.abs(0.5 * (r + g) - b)
    m = px.groupBy(*keys).agg(F.avg(rg).alias("m1"), F.stddev_pop(rg).alias("s1"),
                              F.avg(yb).alias("m2"), F.stddev_pop(yb).alias("s2"))
    return m.select(*keys, (F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))
                            + 0.3 * F.sqrt(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))).alias(name))


def image_colourfulness(px: DataFrame) -> DataFrame:
    return colourfulness(px, ["filename"], "img_colorfulness")


def segment_colourfulness(px: DataFrame, legacy_green: bool = False) -> DataFrame:
    return colourfulness(px, KEYS, "seg_colorfulness", legacy_green)


def ratio_statistics(px: DataFrame) -> DataFrame:
    """Mean and deviation of (R-G)/B and (R+G+B)/3 per segment."""
    ratio, gray = indices.red_green_over_blue(), indices.plain_gray()
    return px.groupBy(*KEYS).agg(F.stddev_pop(ratio).alias("rgb_sd"), F.avg(ratio).alias("rgb_mean"),
                                 F.stddev_pop(gray).alias("gray_sd"), F.avg(gray).alias("gray_mean"))


def paint_segment_means(px: DataFrame, bands=("blue", "green", "red")) -> DataFrame:
    """Each pixel with the mean of its segment, ``<band>_segment``. Hot segments are salted."""
    means = px.groupBy(*KEYS).agg(*[F.avg(b).alias(f"{b}_segment") for b in bands])
    return attach(px, means, KEYS, hint="shuffle_hash")


# ---- spectral features -------------------------------------------------------------------------

def spectral_bands(px: DataFrame) -> DataFrame:
    """Scaled bands, HSV, XYZ and Lab of each pixel, NULL where the pixel is invalid (red 0 or missing).

    The columns are red, green, blue, nir[, rededge], h, s, v, l, a, b, x, y, z.
    """
    extra = ["rededge"] if "rededge" in px.columns else []
    raw = px.select(*KEYS, *[F.when(colour.valid(), colour.scaled(c)).alias(c)
                             for c in ["red", "green", "blue", "nir", *extra]])
    return colour.with_lab(colour.with_xyz(colour.with_hsv(raw)))


def spectral_features(px: DataFrame, images: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per segment: ratios, interquartile band means, whole-image means, colour shares and differences.

    ``images`` (filename, date as yyyymmdd) adds ``day_of_year``. Image means are added up from the
    segments, so the pixels are not read again for them.
    """
    rededge = ["rededge"] if "rededge" in px.columns else []
    px = px.select(*KEYS, *indices.BANDS, *rededge)  # as index_features moves them: beside it they move once
    base = spectral_bands(px)
    named = ["red", "green", "blue", *rededge, "nir", *"hsvlabxyz"]
    r, g, b, n = (F.col(c) for c in ("red", "green", "blue", "nir"))
    means = {"SR": indices.simple_ratio(n, r), "CL_green": indices.chlorophyll(n, g),
             "normalized_R": r / (r + g + b + 1.0), "normalized_G": g / (r + g + b + 1.0),
             "normalized_B": b / (r + g + b + 1.0), "mean_R_by_B": r / (b + 1.0),
             "mean_R_by_B_plus_R": r / (b + r + 1.0)}
    differences = {"R-G": r - g, "R-B": r - b, "G-R": g - r, "G-B": g - b, "B-R": b - r, "B-G": b - g}
    if rededge:
        means["CL_rededge"] = indices.chlorophyll(n, F.col("rededge"))
        means["MTCI"] = indices.mtci(n, F.col("rededge"), r)
    rgb = ["red", "green", "blue"]
    per_segment = base.groupBy(*KEYS).agg(
        *[F.avg(e).alias(name) for name, e in {**means, **differences}.items()],
        (F.greatest(*[F.max(c) for c in rgb]) - F.least(*[F.min(c) for c in rgb])).alias("mean_chroma"),
        *[F.sum(c).alias(f"__{c}") for c in named], F.count("red").alias("__n"))
    inner = grouped_interquartile_means(px, KEYS, named, group_rows, spectral_bands)
    inner = inner.withColumnsRenamed({c: f"{c}_mean" for c in named})
    per_image = per_segment.groupBy("filename").agg(
        *[F.try_divide(F.sum(f"__{c}"), F.sum("__n")).alias(f"image_mean_{c}") for c in named])
    out = join_keyed(join_keyed(per_segment, inner, KEYS), per_image, ["filename"])
    out = out.drop("__n", *[f"__{c}" for c in named])
    # the second Lab conversion gives the first one again: same values under their own names
    twins = {"cl": "l", "ca": "a", "cb": "b"}
    out = out.withColumns({**{f"{t}_mean": F.col(f"{c}_mean") for t, c in twins.items()},
                           **{f"image_mean_{t}": F.col(f"image_mean_{c}") for t, c in twins.items()}})
    if images is not None:
        days = images.select("filename", day_fraction(image_date("date")).alias("day_of_year"))
        # segments lie by image since the last join: no salt, which is a hash of all columns and so works all of them out
        out = join_keyed(out, days, ["filename"], "left")
    return out


def clump_statistics(px: DataFrame, bands=("blue", "green", "red", "nir"), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per given segment: min, max, sum, mean and deviation of each band, and its dense number in the image."""
    stats = px.groupBy(*KEYS).agg(*[f(b).alias(f"{b}_{s}") for b in bands for s, f in (
        ("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg), ("std", F.stddev_pop))])
    return ranks_within(stats, ["filename"], "segment", "segment_number", group_rows)
