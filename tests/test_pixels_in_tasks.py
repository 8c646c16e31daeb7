"""Pixels that many images share a task and a batch for, and neighbours across the edges of tiles."""

import numpy as np
import pytest

from mlframes.operators.raster import regions
from mlframes.sources import images
from registry import base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_pixels(spark):
    rows = spark.range(3 * base.TASK_PIXELS // 256).repartition(1)
    least = spark.sparkContext.defaultParallelism
    assert base.spread(rows, 256).rdd.getNumPartitions() == max(3, least)
    assert base.spread(rows, 256 * 40).rdd.getNumPartitions() == max(120, least)


def touching(px):
    """Pairs of segments by looking at every two pixels' places."""
    at = {(f, r, c): s for f, r, c, s in px}
    return {(f, *sorted((s, at[f, r + i, c + j]))) for (f, r, c), s in at.items() for i in (-1, 0, 1) for j in (-1, 0, 1)
            if at.get((f, r + i, c + j), s) != s}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_neighbours_across_tiles(spark, kind):
    rng = np.random.default_rng(5)
    px = []
    for f, rows, cols in (("a", range(253, 258), range(252, 259)), ("b", range(-3, 2), range(-2, 3)), ("c", range(510, 514), range(3))):
        px += [(f, r, c, int(rng.integers(1, 9))) for r in rows for c in cols]
    px = [(f, r, c, s if kind == "int" else f"s{s}") for f, r, c, s in px]
    df = spark.createDataFrame(px, f"filename string, `row` int, col int, segment {kind}")
    out = regions.adjacent_regions(df)
    assert {tuple(r) for r in out.collect()} == touching(px)
    assert out.count() == len(touching(px))
    assert "Window" not in plan(out)  # pixels move once


def test_raw_images_share_batches(spark, monkeypatch):
    monkeypatch.setattr(images, "_PIXELS", 10)  # images of 2 x 3 pixels one by one, of 6 x 4 in strips of two lines
    rng = np.random.default_rng(6)
    for rows, cols, bands in ((2, 3, 4), (6, 4, 2)):
        made = {f"i{k}": rng.integers(0, 60_000, (rows, cols, bands)).astype("<u2") for k in range(5)}
        df = images.raw_pixels(spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in made.items()], "filename string, content binary"),
                               rows, cols, bands)
        assert "MapInArrow" in plan(df)
        found = {(r["filename"], r["row"], r["col"]): [r[b] for b in ("blue", "green", "red", "nir")] for r in df.collect()}
        assert found == {(k, r, c): [*v[r, c].astype(float), *[None] * (4 - bands)] for k, v in made.items() for r in range(rows) for c in range(cols)}
