"""Outlines whose pixels move once, to tiles, against the neighbourhood of each pixel and brute force."""

import numpy as np
import pytest

from mlframes.operators.raster import shape
from mlframes.plans import storage
from registry.base import pixels


def frame(spark, grids, kind="int", corner=(0, 0)):
    rows = [(name, r + corner[0], c + corner[1], int(grid[r, c]) if kind == "int" else f"s{grid[r, c]}")
            for name, grid in grids.items() for r, c in np.ndindex(grid.shape)]
    return spark.createDataFrame(rows, f"filename string, `row` int, col int, segment {kind}").repartition(3)


@pytest.mark.parametrize("lines,size,kind,corner", [(3, 4, "int", (0, 0)), (2, 5, "string", (3, 7)), (4, 3, "int", (1000, 5000)), (256, 256, "int", (0, 0))])
def test_tiles_and_neighbourhoods_agree(spark, lines, size, kind, corner):
    rng = np.random.default_rng(size)
    grids = {"noise": rng.choice([1, 2, 3], (13, 11)), "mostly one": rng.choice([1, 2], (12, 12), p=[.85, .15]), "dot": np.ones((1, 1), int),
             "ring": np.pad(np.pad(np.ones((6, 6), int), 2, constant_values=2), 1, constant_values=1)}
    px = frame(spark, grids, kind, corner)
    out = {(r["filename"], r["segment"]): r for r in shape.outline_properties(px, lines, size).collect()}
    around = shape.neighbourhood(px)
    whole = {(r["filename"], r["segment"]): r for r in shape.outlines(around).collect()}
    lengths = {(r["filename"], r["segment"]): r["perimeter"] for r in shape.perimeters(around).collect()}
    assert out.keys() == whole.keys() == lengths.keys()
    for key, r in out.items():
        assert r["perimeter"] == pytest.approx(lengths[key])
        assert {c: r[c] for c in whole[key].asDict()} == whole[key].asDict()


def test_pixels_move_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(shape, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.checkpoint(df))
    shape.outline_properties(pixels(spark, "/root/testdata/sf0.001"))
    assert plans and "Window" not in "".join(plans)
