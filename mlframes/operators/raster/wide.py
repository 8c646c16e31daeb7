"""One row per image: join the segment features, rank segments, pivot, attach image-level columns."""

from pyspark.sql import DataFrame, Window, functions as F

from mlframes.operators.raster import KEYS, join_keyed
from mlframes.operators.raster.features import image_colourfulness, index_features, segment_colourfulness, spectral_features
from mlframes.operators.raster.shape import outline_properties, region_properties

RANK = "relabeled_segs"


def rank_segments(features: DataFrame, by: str = "gray_mean_intensity") -> DataFrame:
    """Number the segments of each image from the brightest; equal ones by segment.

    The window holds the segments of one image, as many as the wide table has column groups. Rows lie by the name that the
    wide table has, so that ``pivot_segments`` need not move them again.
    """
    order = Window.partitionBy(_image_name(), "filename").orderBy(F.col(by).desc(), F.col("segment"))
    return features.repartition(_image_name()).withColumn(RANK, F.row_number().over(order))


def _image_name():
    return F.trim("filename", F.lit("\n"))


def _suffixed(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join; names on both sides end in _x (left) and _y (right)."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    return join_keyed(left.withColumnsRenamed({c: f"{c}_x" for c in shared}),
                   right.withColumnsRenamed({c: f"{c}_y" for c in shared}), keys, how)


def join_colour(index: DataFrame, colour: DataFrame) -> DataFrame:
    """Index features with colourfulness, where there is one."""
    return _suffixed(index, colour, KEYS, "left")


def join_segment_features(index: DataFrame, colour: DataFrame, regions: DataFrame, spectral: DataFrame) -> DataFrame:
    """Index features with colourfulness where present, and with region and spectral features."""
    return _suffixed(_suffixed(join_colour(index, colour), regions, KEYS), spectral, KEYS)


def segment_features(px: DataFrame, images: DataFrame | None = None, outlines: bool = True) -> DataFrame:
    """Every feature of every segment. All parts are keyed by segment, so the joins reuse one partitioning."""
    regions = region_properties(px)
    if outlines:
        regions = join_keyed(regions, outline_properties(px).drop("area"), KEYS)
    return join_segment_features(index_features(px), segment_colourfulness(px), regions, spectral_features(px, images))


def pivot_segments(ranked: DataFrame, ranks: int | None = None, largest: int | None = None) -> DataFrame:
    """One row per image with a column ``<feature>_seg_<rank>`` for every feature and rank.

    An image's segments are gathered in rank order, and spread to columns by position: one aggregate per feature, so that those
    that nobody reads are not made, instead of one per column. ``ranks`` may ask for more columns than
    the largest rank needs, not for fewer. Who knows the largest rank gives it: to look for it works all features out once more.
    """
    if largest is None:
        largest = ranked.agg(F.max(RANK)).first()[0] or 0
    if ranks is not None and largest > ranks:
        raise ValueError(f"an image has {largest} segments, more than the {ranks} asked for")
    ranks = ranks or largest
    ranked = ranked.withColumn("filename", _image_name())
    features = [c for c in ranked.columns if c not in ("filename", RANK)]
    images = ranked.groupBy("filename").agg(*[F.sort_array(F.collect_list(F.struct(F.col(RANK), F.col(f"`{c}`").alias("v")))).alias(f"__{j}")
                                              for j, c in enumerate(features)])
    return images.select("filename", *[F.get(f"__{j}", F.lit(i))["v"].alias(f"{c}_seg_{i + 1}")
                                       for j, c in enumerate(features) for i in range(ranks)])


def join_images(catalogue: DataFrame, wide: DataFrame, image_colour: DataFrame, original: DataFrame) -> DataFrame:
    """Wide features with image colourfulness and segment count where present, for catalogued images."""
    per_image = join_keyed(image_colour, original, ["filename"])
    return join_keyed(catalogue, join_keyed(wide, per_image, ["filename"], "left"), ["filename"])


def image_table(px: DataFrame, catalogue: DataFrame, original: DataFrame, ranks: int | None = None, outlines: bool = True) -> DataFrame:
    """One row per catalogued image."""
    ranked = rank_segments(segment_features(px, catalogue.select("filename", "date"), outlines))
    # every segment has its row of features, so the pixels' labels alone give the largest rank
    largest = px.select(*KEYS).distinct().groupBy("filename").count().agg(F.max("count")).first()[0] or 0
    return join_images(catalogue, pivot_segments(ranked, ranks, largest), image_colourfulness(px), original)
