"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from mlframes.operators import columns, curves, metrics, split
from mlframes.operators.encode import Prep
from registry.base import fixture, pixels, table
from registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# fits and files run many jobs of their own; their results are read back
LAZY = sorted(n for n in QUERIES if not re.match(r"s0|s10|k0|m08|m09|m1|a24|a25|j10|r14|streamed|r13", n))


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_row_wise_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith(("r08", "r10", "r12", "r17_image", "a01_ttest_p")):
        assert "Python" not in text and "Pandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = columns.member_rows(table(spark, SF, "part").withColumnRenamed("p_size", "fieldID"), [7]).select("p_partkey")
    text = plan(df)
    assert "PushedFilters: [" in text and "EqualTo(p_size,7)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text


def test_hash_split_is_narrow(spark):
    df = split.add_split(fixture(spark, SF, "groups"), "id")
    assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_group_labels_need_no_join(spark):
    df = split.add_split(fixture(spark, SF, "groups"), "id", "grp", mode="exact")
    assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_curves_shuffle_counts_only(spark):
    text = plan(curves.roc_curve(fixture(spark, SF, "scored"), "y", "p"))
    exchanged = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchanged) <= 2 and "partial_" in text


def test_metrics_are_one_scan(spark):
    text = plan(metrics.regression_metrics(fixture(spark, SF, "regression"), "y", "yhat"))
    assert text.count("FileScan") == 1 and text.count("Exchange ") == 1


def test_small_code_tables_are_broadcast(spark):
    df = fixture(spark, SF, "prep")
    text = plan(Prep.fit(df, id_col="id", threshold=10).transform(df))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_pixels_are_read_once_per_feature_table(spark):
    from mlframes.operators.raster.shape import region_properties
    text = plan(region_properties(pixels(spark, SF)))
    # once by segment and tile; the second exchange moves the tiles' sums
    assert text.count("FileScan") == 1 and text.count("hashpartitioning") == 2


def test_painting_salts_the_segment(spark):
    text = plan(QUERIES["w05_segment_mean_image"](spark, SF).select(F.sum("red_segment")))
    assert "__salt" in text


def test_segment_tables_join_where_they_lie(spark):
    from mlframes.operators.raster.features import index_features
    text = plan(index_features(pixels(spark, SF)))
    assert text.count("hashpartitioning(filename") == 2 and text.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["r02_spectral_features", "r09_region_properties", "r09_region_properties_far", "r11_region_edges",
                                  "r15_edges_below", "r17_pivot_segments", "w05_segment_mean_image", "j06_join_segment_features"])
def test_tables_of_pixels_are_never_broadcast(spark, name):
    """Exploded pixels look as small as the rows they come from, so Spark would send them through the driver."""
    text = plan(QUERIES[name](spark, SF))
    assert "BroadcastExchange" not in text or name == "r02_spectral_features" and text.count("BroadcastExchange") == 1


def test_quantiles_move_bands_and_not_what_is_derived_from_them(spark):
    from mlframes.operators.raster.features import index_features, spectral_features
    for df, derived in ((index_features(pixels(spark, SF)), "MSAVI"), (spectral_features(pixels(spark, SF)), "AS v")):
        lines = plan(df).splitlines()
        moved = [below for line, below in zip(lines, lines[1:]) if "REPARTITION_BY_COL" in line]
        assert len(moved) == 1 and "nir" in moved[0] and derived not in moved[0]


def test_perimeters_move_each_place_once(spark):
    from mlframes.operators.raster import shape
    text = plan(shape.perimeters(shape.neighbourhood(pixels(spark, SF))))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert "struct(w" not in text  # what goes along columns is moved once
    assert not any("row" in line and "col" in line for line in moved)  # sums of a column are formed where it lies
