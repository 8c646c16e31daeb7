"""The wide table works features out once, and only those that are read."""

import re

from pyspark.sql import functions as F

from mlframes.operators.raster import KEYS, features, wide
from registry.base import pixels


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_segments_are_not_moved_again(spark):
    stats = pixels(spark, "/root/testdata/sf0.001").groupBy(*KEYS).agg(F.avg("red").alias("gray_mean_intensity"), F.max("nir").alias("nir_max"))
    ranked = wide.rank_segments(stats)
    flat = wide.pivot_segments(ranked, 4)
    text = flat._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2, text  # by segment, by name
    assert "nir" not in executed(flat.select("filename", "gray_mean_intensity_seg_1"))


def test_features_are_not_worked_out_to_find_the_largest_rank(spark, monkeypatch):
    px = pixels(spark, "/root/testdata/sf0.001")
    catalogue = px.select("filename", F.lit("20240201").alias("date")).distinct()
    given = []
    monkeypatch.setattr(wide, "pivot_segments", lambda ranked, ranks, largest=None: given.append(largest) or ranked.select("filename"))
    wide.image_table(px, catalogue, px.select("filename").distinct(), 4)
    assert given == [4]


def test_bands_move_once(spark):
    px = pixels(spark, "/root/testdata/sf0.001")
    both = features.index_features(px).join(features.spectral_features(px).hint("merge"), KEYS)
    text = executed(both)
    assert re.search(r"ReusedExchange.*REPARTITION_BY_COL", text), text


def test_days_are_joined_where_the_segments_lie(spark):
    px = pixels(spark, "/root/testdata/sf0.001")
    some = px.select("filename", F.lit("20240201").alias("date")).distinct().where("filename <> 'img_1'")
    out = features.spectral_features(px, some).select(*KEYS, "day_of_year", "SR")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "xxhash64" not in text and "sort_array" not in text
    found = {r["filename"]: r["day_of_year"] for r in out.collect()}
    assert found["img_1"] is None and set(found.values()) == {None, 32 / 365}
    assert out.count() == px.select(*KEYS).distinct().count()
