"""Shapes, regions and features on images drawn by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframes.functions import indices
from mlframes.operators.raster import KEYS, features, regions, shape, superpixel, wide


def image(spark, text, name="f", bands=None, parts=3):
    """Pixel table of a drawing: one digit per pixel names its segment."""
    rows = []
    for y, line in enumerate(text.split()):
        for x, c in enumerate(line):
            b, g, r, n = bands(y, x, int(c)) if bands else (10.0 * int(c), 20.0 * int(c), 30.0 * int(c) + 1, 40.0 * int(c))
            rows.append((name, y, x, b, g, r, n, int(c)))
    schema = "filename string, `row` int, col int, blue double, green double, red double, nir double, segment int"
    return spark.createDataFrame(rows, schema).repartition(parts)


L_SHAPE = "1122 1122 1111 1111"
RING = "11111 12221 12321 12221 11111"
SPIRAL = "111111 122221 121121 121221 121111 122222"


def by_segment(df):
    return {r["segment"]: r for r in df.collect()}


def test_neighbourhood_of_the_corner_and_the_middle(spark):
    around = {(r["row"], r["col"]): r for r in shape.neighbourhood(image(spark, "123 456 789")).collect()}
    assert [around[1, 1][d] for d in ("nw", "n", "ne", "w", "e", "sw", "s", "se")] == [1, 2, 3, 4, 6, 7, 8, 9]
    assert [around[0, 0][d] for d in ("nw", "n", "ne", "w", "e", "sw", "s", "se")] == [None, None, None, None, 2, None, 4, 5]


def test_outline_of_an_l(spark):
    out = by_segment(shape.outline_properties(image(spark, L_SHAPE)))
    assert out[1]["area"] == out[1]["filled_area"] == 12 and out[1]["euler_number"] == 1
    # the hull cuts the corner between the arms: one more pixel lies on its edge
    assert out[1]["convex_area"] == 13 and out[1]["solidity"] == pytest.approx(12 / 13)
    assert out[2]["convex_area"] == 4 and out[2]["perimeter"] == 4.0


def test_ring_has_a_hole(spark):
    out = by_segment(shape.outline_properties(image(spark, RING)))
    assert out[1]["euler_number"] == 0 and out[1]["filled_area"] == 25 and out[1]["convex_area"] == 25
    assert out[2]["euler_number"] == 0 and out[2]["filled_area"] == 9
    assert out[3]["euler_number"] == 1 and out[3]["area"] == 1 and out[3]["perimeter"] == 0.0


def test_spiral_is_open(spark):
    out = by_segment(shape.outline_properties(image(spark, SPIRAL)))
    assert out[2]["filled_area"] == out[2]["area"]


def test_diagonal_pixels_are_one_part(spark):
    out = by_segment(shape.outline_properties(image(spark, "211 121 112")))
    assert out[2]["euler_number"] == 1 and out[2]["convex_area"] == 3
    # the corners of segment 1 touch diagonally and close a ring around the middle
    assert out[1]["euler_number"] == 0 and out[1]["filled_area"] == 7


def brute_fill(mask):
    """Flood from outside with four neighbours; what stays dry is filled."""
    h, w = mask.shape
    wet, todo = np.zeros((h + 2, w + 2), bool), [(0, 0)]
    padded = np.pad(mask, 1)
    while todo:
        y, x = todo.pop()
        if 0 <= y < h + 2 and 0 <= x < w + 2 and not wet[y, x] and not padded[y, x]:
            wet[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return int((~wet).sum())


def parts_minus_holes(mask):
    """Eight-connected parts less four-connected holes, by flooding."""
    def count(m, diagonal):
        m, n = m.copy(), 0
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or 0 in (a, b)]
        for y, x in np.argwhere(m):
            if m[y, x]:
                n, todo = n + 1, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b]:
                        m[a, b] = False
                        todo += [(a + i, b + j) for i, j in steps]
        return n

    return count(mask, True) - (count(~np.pad(mask, 1), False) - 1)


def brute_perimeter(mask):
    p = np.pad(mask, 2)
    inner = p & np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1)
    border = (p & ~inner).astype(int)
    code = sum(w * np.roll(np.roll(border, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)
               for w in [1 if i == j == 0 else 2 if 0 in (i, j) else 10])
    return sum(v * int((code == k).sum()) for k, v in shape.BORDER_LENGTHS.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_shapes_against_brute_force(spark, seed):
    grid = np.random.default_rng(seed).integers(1, 4, (9, 11))
    px = image(spark, " ".join("".join(map(str, line)) for line in grid))
    out = by_segment(shape.outline_properties(px))
    for s in (1, 2, 3):
        mask = grid == s
        assert out[s]["area"] == mask.sum() and out[s]["filled_area"] == brute_fill(mask)
        assert out[s]["euler_number"] == parts_minus_holes(mask)
        assert out[s]["perimeter"] == pytest.approx(brute_perimeter(mask))


def brute_hull(mask):
    """Pixels that no straight line through two edge midpoints parts from the segment, by turning around all pairs."""
    pts = sorted({(y + i, x + j) for y, x in np.argwhere(mask) for i, j in ((0, .5), (0, -.5), (.5, 0), (-.5, 0))})
    edges = [(p, q) for p in pts for q in pts if p != q
             and all((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) >= -1e-9 for r in pts)]
    return sum(all((q[0] - p[0]) * (x - p[1]) - (q[1] - p[1]) * (y - p[0]) >= -1e-9 for p, q in edges)
               for y, x in np.ndindex(mask.shape))


SHAPES = {"comb": "1" * 13 + " " + " ".join(["12" * 6 + "1"] * 8), "spiral": "\n".join([
    "1111111111", "1222222221", "1211111121", "1212222121", "1212112121", "1212212121", "1211112121", "1222222121", "1111111121", "2222222221"]),
    "rings": "1111111111 1222222221 1211111121 1212222121 1212112121 1212112121 1212222121 1211111121 1222222221 1111111111",
    "far apart": "1222222 2222222 2222222 2222222 2222222 2222221 2222122 2221212 2222122"}


@pytest.mark.parametrize("name", [*SHAPES, 4, 5])
@pytest.mark.parametrize("lines_per_block", [2, 3])
def test_outlines_by_blocks_of_lines(spark, name, lines_per_block):
    text = SHAPES.get(name)
    if text is None:
        grid = np.random.default_rng(name).choice([1, 2], (10, 9), p=[.65, .35])
        text = " ".join("".join(map(str, line)) for line in grid)
    grid = np.array([list(map(int, line)) for line in text.split()])
    out = by_segment(shape.outlines(shape.neighbourhood(image(spark, text)), lines_per_block))
    for s in (1, 2):
        mask = grid == s
        assert (out[s]["area"], out[s]["filled_area"], out[s]["euler_number"]) == (mask.sum(), brute_fill(mask), parts_minus_holes(mask))
        assert out[s]["convex_area"] == brute_hull(mask)


def test_moments_of_a_shifted_rectangle(spark):
    big = "\n".join(["2" * 12] * 3 + ["2222" + "11111" + "222"] * 2 + ["2" * 12] * 2)
    r = by_segment(shape.region_properties(image(spark, big)))[1]
    assert r["area"] == 10 and list(r["bbox"]) == [3, 4, 5, 9] and r["extent"] == 1.0
    assert (r["centroid_y"], r["centroid_x"], r["local_centroid_y"], r["local_centroid_x"]) == (3.5, 6.0, 0.5, 2.0)
    assert r["moments"][:4] == pytest.approx([10, 20, 60, 200])
    assert r["moments_central"][shape.ORDERS.index((0, 2))] == pytest.approx(20)
    assert r["major_axis_length"] == pytest.approx(4 * math.sqrt(2)) and r["orientation"] == pytest.approx(math.pi / 2)
    assert r["eccentricity"] == pytest.approx(math.sqrt(1 - 0.25 / 2))
    assert r["weighted_centroid"] == pytest.approx([3.5, 6.0])


def test_direction_of_slanted_and_even_shapes(spark):
    slanted = by_segment(shape.region_properties(image(spark, "1222 2122 2212 2221")))
    assert slanted[1]["orientation"] == pytest.approx(math.pi / 4)
    even = by_segment(shape.region_properties(image(spark, "2222222 2222112 2222112 2222222")))
    assert even[1]["orientation"] == pytest.approx(-math.pi / 4) and even[1]["eccentricity"] == pytest.approx(0)


def test_hu_moments_ignore_turning(spark):
    a = by_segment(shape.region_properties(image(spark, "1222 1222 1122 2222", bands=lambda *_: (1.0,) * 4)))[1]
    b = by_segment(shape.region_properties(image(spark, "2222 2221 2111 2222", bands=lambda *_: (1.0,) * 4)))[1]
    assert a["moments_hu"] == pytest.approx(b["moments_hu"], abs=1e-12)


def test_indices_are_null_where_undefined(spark):
    px = image(spark, "1", bands=lambda *_: (0.0, 0.0, 0.0, 0.0))
    r = indices.with_indices(px).first()
    assert r["NDVI_r"] is None and r["EVI"] == 0.0 and r["SAVI"] == 0.0
    # the root in MSAVI is negative only for negative bands
    assert indices.with_indices(image(spark, "1", bands=lambda *_: (0.0, 0.0, -9.0, 0.0))).first()["MSAVI"] is None


def test_hot_segments_give_the_same_features(spark):
    px = image(spark, "11111112 11111112 11111132 11111332", bands=lambda y, x, s: (y + 1.0, x + 2.0, y * x % 7 + 0.0, 3.0 * x + y))
    for make in (features.index_features, features.spectral_features):
        want, got = by_segment(make(px)), by_segment(make(px, group_rows=5))
        assert want.keys() == got.keys()
        for s in want:
            for c, v in want[s].asDict().items():
                assert got[s][c] == (pytest.approx(v) if isinstance(v, float) else v), (s, c)


def test_segment_without_valid_pixels_keeps_its_row(spark):
    px = image(spark, "12", bands=lambda y, x, s: (5.0, 5.0, 0.0 if s == 1 else 5.0, 5.0))
    out = by_segment(features.spectral_features(px))
    assert out[1]["SR"] is None and out[1]["red_mean"] is None and out[1]["mean_chroma"] is None
    assert out[1]["image_mean_red"] == pytest.approx(5 / 65535)


def test_lab_of_known_colours(spark):
    white = image(spark, "1", bands=lambda *_: (65535.0,) * 4)
    r = features.spectral_bands(white).first()
    assert r["l"] == pytest.approx(100, abs=1e-2) and r["a"] == pytest.approx(0, abs=1e-2) and r["s"] == 0.0
    red = features.spectral_bands(image(spark, "1", bands=lambda *_: (0.0, 0.0, 65535.0, 0.0))).first()
    assert (red["h"], red["s"], red["v"]) == (0.0, 1.0, 1.0)
    assert (red["l"], red["a"], red["b"]) == pytest.approx((53.24, 80.09, 67.2), abs=0.05)


def test_rededge_adds_its_features(spark):
    px = image(spark, "11 12").withColumn("rededge", F.lit(100.0))
    out = by_segment(features.spectral_features(px))
    assert out[1]["rededge_mean"] is None and out[1]["image_mean_rededge"] == pytest.approx(100 / 65535)
    assert out[1]["CL_rededge"] is not None and out[1]["MTCI"] is not None


def test_painting_keeps_every_pixel(spark):
    px = image(spark, RING)
    out = features.paint_segment_means(px)
    assert out.count() == 25 and out.where("abs(red_segment - red) > 1e-9").count() == 0


def test_region_graph_includes_corners(spark):
    px = image(spark, "1122 1122 3344")
    edges = {(r["n1"], r["n2"]): r["weight"] for r in regions.region_edges(px).collect()}
    assert set(edges) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert edges[1, 2] == pytest.approx(math.sqrt(10 ** 2 + 20 ** 2 + 30 ** 2))
    near = regions.edges_below(regions.region_edges(px), shape.segment_centroids(px), 40.0).collect()
    assert {(r["n1"], r["n2"]) for r in near} == {(1, 2), (2, 3), (3, 4)}


def test_merging_leaves_the_wanted_number(spark):
    px = image(spark, "1234567 1234567", bands=lambda y, x, s: (float(s * s),) * 4)
    nodes, edges = regions.region_nodes(px), regions.region_edges(px)
    for wanted in (1, 3, 7, 9):
        out = {r["segment"]: r["merged"] for r in regions.merge_regions(nodes, edges, wanted).collect()}
        assert set(out) == set(range(1, 8)) and set(out.values()) == set(range(1, min(wanted, 7) + 1))
    two = {r["segment"]: r["merged"] for r in regions.merge_regions(nodes, edges, 2).collect()}
    assert len({two[s] for s in (1, 2, 3, 4)}) == 1  # the dark end is closest in colour
    merged = regions.relabel_pixels(px, regions.merge_regions(nodes, edges, 3))
    assert merged.count() == 14


def test_merging_with_other_rules(spark):
    px = image(spark, "123", bands=lambda y, x, s: (float(s * s),) * 4)
    nodes, edges = regions.region_nodes(px), regions.region_edges(px)
    far = regions.merge_regions(nodes, edges, 2, weigh=lambda a, b: -regions.colour_distance(a, b)).collect()
    out = {r["segment"]: r["merged"] for r in far}
    assert out[2] == out[3] != out[1]


def test_islands_cannot_merge(spark):
    px = image(spark, "1", "a").unionByName(image(spark, "22", "b"))
    nodes = regions.region_nodes(px)
    assert regions.merge_regions(nodes, regions.region_edges(px, nodes), 1).count() == 2


def test_cutting_keeps_the_lightest_edges(spark):
    px = image(spark, "1234 1234", bands=lambda y, x, s: ({1: 1.0, 2: 2.0, 3: 50.0, 4: 90.0}[s],) * 4)
    out = by_segment(regions.threshold_regions(px, 50.0))
    assert out[1]["component"] == out[2]["component"] == 1 and out[3]["component"] == 3 and out[4]["component"] == 4
    assert out[2]["red_mean"] == 1.5


def test_superpixels_cover_images_with_compact_regions(spark):
    halves = "\n".join("1" * 20 + "2" * 20 for _ in range(40))
    px = image(spark, halves, bands=lambda y, x, s: ((200.0,) * 4 if x < 20 else (20.0,) * 4)).withColumnRenamed("segment", "truth")
    out = superpixel.superpixels(px, n_segments=9, iterations=4, connected=False)
    assert out.count() == 1600 and out.where("segment is null").count() == 0
    found = out.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_distinct("truth").alias("sides"),
                                   (F.max("row") - F.min("row")).alias("h"), (F.max("col") - F.min("col")).alias("w"))
    rows = found.collect()
    assert 6 <= len(rows) <= 9 and all(r["sides"] == 1 for r in rows)
    assert all(r["h"] < 30 and r["w"] < 30 for r in rows)
    merged, original = superpixel.segment_images(px, n_segments=9, standardize=2, iterations=3, sigma=0.0, connected=False)
    assert merged.select("segment").distinct().count() == 2 and merged.count() == 1600
    assert merged.groupBy("segment").agg(F.count_distinct("truth").alias("t")).where("t > 1").count() == 0
    assert original.first()["num_orig_segments"] >= 6


def test_several_segment_counts(spark):
    px = image(spark, "\n".join("1" * 12 for _ in range(12))).drop("segment")
    out = {r["n_segments"]: r["num_orig_segments"] for r in superpixel.try_segment_counts(px, (4, 9), iterations=1).collect()}
    assert out == {4: 4, 9: 9}


def test_ranking_and_pivot_round_trip(spark):
    px = image(spark, "12 34", "a").unionByName(image(spark, "12", "b"))
    stats = px.groupBy(*KEYS).agg(F.avg("red").alias("gray_mean_intensity"), F.collect_list("col").alias("cols"))
    ranked = wide.rank_segments(stats)
    assert {(r["filename"], r["segment"]): r[wide.RANK] for r in ranked.collect()} == {
        ("a", 4): 1, ("a", 3): 2, ("a", 2): 3, ("a", 1): 4, ("b", 2): 1, ("b", 1): 2}
    flat = wide.pivot_segments(ranked)
    assert flat.count() == 2 and len(flat.columns) == 1 + 3 * 4
    back = {(r["filename"], r[f"segment_seg_{i}"]): r[f"gray_mean_intensity_seg_{i}"] for r in flat.collect() for i in range(1, 5)}
    back.pop(("b", None))
    assert back == {(r["filename"], r["segment"]): r["gray_mean_intensity"] for r in stats.collect()}


def test_image_table(spark):
    px = image(spark, L_SHAPE, "a").unionByName(image(spark, RING, "b"))
    catalogue = spark.createDataFrame([("a", 7, "/a.png", "20240201"), ("b", 8, "/b.png", "20240301"), ("c", 9, "/c.png", "20240301")],
                                      "filename string, fieldID int, img_path string, date string")
    out = {r["filename"]: r for r in wide.image_table(px, catalogue, superpixel.region_counts(px)).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"]["area_seg_1"] == 4 and out["a"]["num_orig_segments"] == 2 and out["a"]["area_seg_3"] is None
    assert out["b"]["euler_number_seg_3"] == 0 and out["a"]["day_of_year_seg_1"] == pytest.approx(32 / 365)
    assert out["a"]["red_mean_x_seg_1"] == 61.0 and out["a"]["red_mean_y_seg_1"] is None


def test_clumps_get_dense_numbers(spark):
    out = by_segment(features.clump_statistics(image(spark, "2277 9977")))
    assert {s: r["segment_number"] for s, r in out.items()} == {2: 1, 7: 2, 9: 3}
    assert out[7]["blue_sum"] == 280.0


def test_pieces_hang_together_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(superpixel, "TILE", 4)
    # a snake of 1 in a field of 2, a stray 3, and 2 cut in two by the snake
    lines = ["1111111111", "2222222221", "2222222221", "1111111111", "1222222222", "1222232222", "1111111111", "2222222221", "2222222221"]
    rows = [("f", r, c, int(s)) for r, line in enumerate(lines) for c, s in enumerate(line)]
    px = spark.createDataFrame(rows, "filename string, row int, col int, segment int").repartition(3)
    out = {(r["row"], r["col"]): r["segment"] for r in superpixel.connected_pieces(px, 4, 0.3).collect()}
    assert len(out) == 90
    groups = {}
    for at, s in out.items():
        groups.setdefault(s, set()).add(at)
    for cells in groups.values():
        todo, seen = [next(iter(cells))], set()
        while todo:
            r, c = at = todo.pop()
            if at in cells and at not in seen:
                seen.add(at)
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        assert seen == cells and len(cells) >= 90 / 4 * 0.3
    snake = {(r, c) for r, line in enumerate(lines) for c, s in enumerate(line) if s == "1"}
    assert snake | {(5, 5)} in groups.values() and len(groups) == 4  # the stray joined the largest piece it touches


def test_smoothing_keeps_constants_and_rows(spark):
    rows = [("f", r, c, 7.0, float(c), None, r + c) for r in range(6) for c in range(9)]
    px = spark.createDataFrame(rows, "filename string, row int, col int, blue double, green double, red double, extra int")
    out = superpixel.smoothed(px, 2.0).collect()
    assert len(out) == 54
    for r in out:
        assert r["blue"] == pytest.approx(7) and r["red"] == 0 and r["extra"] == r["row"] + r["col"]
    weights = superpixel.gaussian_weights(2.0)
    line = np.convolve(np.pad(np.arange(9.0), 8, mode="symmetric"), weights, "valid")
    assert {r["col"]: r["green"] for r in out} == {c: pytest.approx(v) for c, v in enumerate(line)}


def test_moments_far_from_the_corner(spark):
    rng = np.random.default_rng(4)
    cells = {(int(a), int(b)) for a, b in rng.normal(300, 60, (800, 2))}
    rows = [("f", 1, r, c, float(r % 7), float(c % 5), float((r * c) % 11)) for r, c in cells]
    schema = "filename string, segment int, row int, col int, blue double, green double, red double"
    near = shape.region_properties(spark.createDataFrame(rows, schema)).first()
    far = shape.region_properties(spark.createDataFrame([(f, s, r + 20_000, c + 20_000, *b) for f, s, r, c, *b in rows], schema)).first()
    r, c = np.array(sorted(cells)).T
    for (p, q), value in zip(shape.ORDERS, near["moments_central"]):
        assert value == pytest.approx((((r - r.mean()) ** p) * ((c - c.mean()) ** q)).sum(), rel=1e-6, abs=1e-3)
    for name in ("moments", "moments_central", "weighted_moments_central", "moments_hu", "weighted_moments_hu", "inertia_tensor_eigvals"):
        assert far[name] == pytest.approx(near[name], rel=1e-6, abs=1e-6), name
    assert far["centroid_y"] - 20_000 == pytest.approx(near["centroid_y"]) and far["orientation"] == pytest.approx(near["orientation"])


def test_rounds_in_a_task_and_between_tasks_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f, r, c, *(float(v) for v in rng.integers(0, 256, 3))) for f, h, w in (("a", 20, 31), ("b", 9, 7), ("c", 1, 1))
            for r in range(h) for c in range(w)]
    px = spark.createDataFrame(rows, "filename string, row int, col int, blue double, green double, red double").repartition(3)
    within = superpixel.superpixels(px, 6, sigma=1.0, iterations=40, connected=False)
    monkeypatch.setattr(superpixel, "WHOLE", 100)
    between = superpixel.superpixels(px, 6, sigma=1.0, iterations=40, connected=False)
    assert within.count() == len(rows)
    assert set(map(tuple, within.select("filename", "row", "col", "segment").collect())) == set(
        map(tuple, between.select("filename", "row", "col", "segment").collect()))


def test_smoothing_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(superpixel, "TILE", 8)
    values = np.random.default_rng(6).integers(0, 256, (19, 23)).astype(float)
    rows = [("f", r, c, float(values[r, c]), 1.0, 0.0) for r in range(19) for c in range(23)]
    px = spark.createDataFrame(rows, "filename string, row int, col int, blue double, green double, red double").repartition(3)
    weights = superpixel.gaussian_weights(1.5)
    reach = len(weights) // 2
    for axis in (0, 1):
        values = np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach, mode="symmetric"), weights, "valid"), axis, values)
    out = superpixel.smoothed(px, 1.5).collect()
    assert len(out) == 19 * 23
    assert all(r["blue"] == pytest.approx(values[r["row"], r["col"]]) and r["green"] == pytest.approx(1) for r in out)


def test_groups_stay_whole_and_share_calls(spark):
    from mlframes.plans import groups
    import pyarrow as pa

    def sizes(table):
        found = table.group_by("k").aggregate([([], "count_all")])
        return pa.table({"k": found.column("k"), "n": found.column("count_all"), "calls": [1] + [0] * (found.num_rows - 1)})

    df = spark.range(300_000).selectExpr("case when id < 150000 then -1 else id % 1000 end as k")
    out = groups.map_groups(df, ["k"], sizes, "k long, n long, calls long").collect()
    assert {r["k"]: r["n"] for r in out} == {-1: 150_000, **{k: 150 for k in range(1000)}} and len(out) == 1001
    assert sum(r["calls"] for r in out) < 40
