"""Region properties of segments: moments, ellipses, intensities, perimeter, Euler number, hull."""

import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from mlframes.functions import colour
from mlframes.operators.raster import KEYS, join_keyed
from mlframes.plans.components import connected_components
from mlframes.plans.groups import codes, map_groups, run_starts
from mlframes.plans.storage import checkpoint

# Moment orders (p over rows, q over columns) up to three: the order of entries in moment arrays.
ORDERS = [(p, q) for p in range(4) for q in range(4 - p)]


def _power(x: str, n: int) -> str:
    return " * ".join([x] * n) if n else "1D"


def _about(prefix: str, row: str, col: str) -> str:
    """Array of moments about (row, col) from sums about the origin, by the binomial formula."""
    def one(p, q):
        return " + ".join(f"{prefix}{i}{j} * {comb(p, i) * comb(q, j)} * {_power(f'(-{row})', p - i)} * {_power(f'(-{col})', q - j)}"
                          for i in range(p + 1) for j in range(q + 1))

    return "array(" + ", ".join(one(p, q) for p, q in ORDERS) + ")"


def _entry(array: str, p: int, q: int) -> str:
    return f"{array}[{ORDERS.index((p, q))}]"


def _normalised(array: str) -> str:
    """Central moments over powers of the total; NULL below order two."""
    return "array(" + ", ".join(
        f"try_divide({_entry(array, p, q)}, pow({_entry(array, 0, 0)}, {(p + q) / 2 + 1}D))" if p + q >= 2
        else "cast(null as double)" for p, q in ORDERS) + ")"


def _invariants(array: str) -> str:
    """The seven moment invariants of Hu from normalised moments."""
    n20, n02, n11 = (_entry(array, *o) for o in ((2, 0), (0, 2), (1, 1)))
    n30, n21, n12, n03 = (_entry(array, *o) for o in ((3, 0), (2, 1), (1, 2), (0, 3)))
    a, b = f"({n30} + {n12})", f"({n21} + {n03})"
    c, d = f"({n30} - 3D * {n12})", f"(3D * {n21} - {n03})"
    e, f, g = f"({n20} - {n02})", f"({a} * {a} - 3D * {b} * {b})", f"(3D * {a} * {a} - {b} * {b})"
    return "array(" + ", ".join([
        f"{n20} + {n02}", f"{e} * {e} + 4D * {n11} * {n11}", f"{c} * {c} + {d} * {d}", f"{a} * {a} + {b} * {b}",
        f"{c} * {a} * {f} + {d} * {b} * {g}", f"{e} * ({a} * {a} - {b} * {b}) + 4D * {n11} * {a} * {b}",
        f"{d} * {a} * {f} - {c} * {b} * {g}"]) + ")"


#: Side of the tiles that sums are formed in: powers of a pixel's place in its tile are small whole numbers, so the sums are exact.
TILE = 256


def region_properties(px: DataFrame, gray: str = "bgr") -> DataFrame:
    """One row per segment with its moment, ellipse and intensity properties.

    Sums of ``row^p * col^q`` are formed per segment and tile, about the tile's corner, and combine before the shuffle. A
    tile's few numbers then move to the corner of the segment's bounding box, where they add up. So neither the place of a
    segment in a large image costs digits, nor does a huge segment gather in one task. Moment arrays hold the orders of
    ``ORDERS``. ``gray`` picks the luma order.
    """
    px = px.select(*KEYS, "row", "col", "red", "green", "blue", F.expr(f"floor(row / {TILE})").alias("__tr"),
                   F.expr(f"floor(col / {TILE})").alias("__tc"), colour.gray(gray).alias("__g"))
    px = px.withColumns({"__r": F.expr(f"cast(row - __tr * {TILE} as double)"), "__c": F.expr(f"cast(col - __tc * {TILE} as double)")})
    bands = {"gray": "__g", "red": "red", "green": "green", "blue": "blue"}
    sums = [F.expr(f"sum({_power('__r', p)} * {_power('__c', q)}) as __t{p}{q}") for p, q in ORDERS]
    sums += [F.expr(f"sum(__g * {_power('__r', p)} * {_power('__c', q)}) as __v{p}{q}") for p, q in ORDERS]
    tiles = px.groupBy(*KEYS, "__tr", "__tc").agg(
        F.count("*").alias("__n"), F.min("row").alias("__top"), F.max("row").alias("__bottom"),
        F.min("col").alias("__left"), F.max("col").alias("__right"), *sums,
        *[f(b).alias(f"__{name}_{stat}") for name, b in bands.items()
          for stat, f in (("max", F.max), ("min", F.min), ("sum", F.sum), ("count", F.count))])
    whole = Window.partitionBy(*KEYS)
    # how far the segment's box lies behind the tile's corner
    tiles = tiles.withColumns({"__dr": (F.min("__top").over(whole) - F.col("__tr") * TILE).cast("double"),
                               "__dc": (F.min("__left").over(whole) - F.col("__tc") * TILE).cast("double")})
    for kind, prefix in (("m", "__t"), ("w", "__v")):
        tiles = tiles.withColumn(f"__{kind}", F.expr(_about(prefix, "__dr", "__dc")))
    s = tiles.groupBy(*KEYS).agg(
        F.sum("__n").alias("area"), F.min("__top").alias("__top"), F.max("__bottom").alias("__bottom"),
        F.min("__left").alias("__left"), F.max("__right").alias("__right"),
        *[F.sum(F.col(f"__{kind}")[i]).alias(f"__{kind}{p}{q}") for kind in "mw" for i, (p, q) in enumerate(ORDERS)],
        *[c for name in bands for c in (
            F.max(f"__{name}_max").alias(f"{name}_max_intensity"),
            F.try_divide(F.sum(f"__{name}_sum"), F.sum(f"__{name}_count")).alias(f"{name}_mean_intensity"),
            F.min(f"__{name}_min").alias(f"{name}_min_intensity"))])
    s = s.selectExpr(
        "*", "segment as label", "array(__top, __left, __bottom + 1, __right + 1) as bbox",
        "cast((__bottom - __top + 1) * (__right - __left + 1) as bigint) as bbox_area",
        "cast(__top as double) as __r0", "cast(__left as double) as __c0",
        "__m10 / area as local_centroid_y", "__m01 / area as local_centroid_x",
        "try_divide(__w10, __w00) as __wy", "try_divide(__w01, __w00) as __wx")
    s = s.selectExpr(
        "*", "area / bbox_area as extent", f"sqrt(area * {4 / math.pi!r}D) as equivalent_diameter",
        "__r0 + local_centroid_y as centroid_y", "__c0 + local_centroid_x as centroid_x",
        "array(__r0 + __wy, __c0 + __wx) as weighted_centroid", "array(__wy, __wx) as weighted_local_centroid",
        f"{_about('__m', '0D', '0D')} as moments", f"{_about('__m', 'local_centroid_y', 'local_centroid_x')} as moments_central",
        f"{_about('__w', '0D', '0D')} as weighted_moments", f"{_about('__w', '__wy', '__wx')} as weighted_moments_central")
    mu = {o: _entry("moments_central", *o) for o in ((0, 0), (0, 2), (1, 1), (2, 0))}
    s = s.selectExpr(
        "*", f"{_normalised('moments_central')} as moments_normalized", f"{_normalised('weighted_moments_central')} as __wn",
        f"{mu[0, 2]} / {mu[0, 0]} as __a", f"-{mu[1, 1]} / {mu[0, 0]} as __b", f"{mu[2, 0]} / {mu[0, 0]} as __c")
    spread = "sqrt((__a - __c) * (__a - __c) / 4D + __b * __b)"
    # a symmetric region has no direction: decide that with a tolerance, not by the last bits
    s = s.selectExpr(
        "*", f"{_invariants('moments_normalized')} as moments_hu", f"{_invariants('__wn')} as weighted_moments_hu",
        "array(__a, __b, __b, __c) as inertia_tensor", f"greatest((__a + __c) / 2D + {spread}, 0D) as __l1",
        f"greatest((__a + __c) / 2D - {spread}, 0D) as __l2", "abs(__a - __c) <= 1e-9D * (__a + __c) as __even",
        "if(abs(__b) <= 1e-9D * (__a + __c), 0D, __b) as __tilt")
    s = s.selectExpr(
        "*", "array(__l1, __l2) as inertia_tensor_eigvals", "4D * sqrt(__l1) as major_axis_length",
        "4D * sqrt(__l2) as minor_axis_length",
        "if(__l1 = 0, 0D, sqrt(greatest(1D - try_divide(__l2, __l1), 0D))) as eccentricity",
        f"case when __even and __tilt < 0 then {math.pi / 4!r}D when __even then -{math.pi / 4!r}D "
        "else 0.5D * atan2(-2D * __tilt, __c - __a) end as orientation")
    return s.drop(*[c for c in s.columns if c.startswith("__")])


def segment_centroids(px: DataFrame) -> DataFrame:
    """(filename, segment, centroid_y, centroid_x)."""
    return px.groupBy(*KEYS).agg(F.avg("row").alias("centroid_y"), F.avg("col").alias("centroid_x"))


# ---- neighbourhoods ----------------------------------------------------------------------------

def neighbourhood(px: DataFrame) -> DataFrame:
    """Add the segments of the eight neighbours: nw, n, ne, w, e, sw, s, se; NULL outside the image.

    Two windows, along image rows and then along image columns, instead of eight self joins. A window
    holds one line of one image, so a large image still spreads over many tasks.
    """
    line = Window.partitionBy("filename", "row").orderBy("col")
    px = px.select("filename", "row", "col", "segment",
                   F.when(F.lag("col").over(line) == F.col("col") - 1, F.lag("segment").over(line)).alias("w"),
                   F.when(F.lead("col").over(line) == F.col("col") + 1, F.lead("segment").over(line)).alias("e"))
    down = Window.partitionBy("filename", "col").orderBy("row")
    above, below = F.lag("row").over(down) == F.col("row") - 1, F.lead("row").over(down) == F.col("row") + 1
    three = ("w", "segment", "e")  # one by one: a struct of them would be moved beside them
    return px.select("filename", "row", "col", "segment", *[F.when(above, F.lag(c).over(down)).alias(n) for c, n in zip(three, ("nw", "n", "ne"))],
                     "w", "e", *[F.when(below, F.lead(c).over(down)).alias(n) for c, n in zip(three, ("sw", "s", "se"))])


def _same(name: str) -> Column:
    return F.col(name).eqNullSafe(F.col("segment"))


# Length of a border pixel by 1 + 2 x straight + 10 x diagonal border neighbours
# (Benkrid and Crookes, 2000).
STRAIGHT, DIAGONAL, MIXED = 1.0, math.sqrt(2), (1 + math.sqrt(2)) / 2
BORDER_LENGTHS = {5: STRAIGHT, 7: STRAIGHT, 15: STRAIGHT, 17: STRAIGHT, 25: STRAIGHT, 27: STRAIGHT,
                  21: DIAGONAL, 33: DIAGONAL, 13: MIXED, 23: MIXED}


def perimeters(around: DataFrame) -> DataFrame:
    """(filename, segment, perimeter) from ``neighbourhood``. Only places beside border pixels are shuffled, once each: the sums
    along an image column are formed where the column lies, those along a line by a window."""
    border = around.where(~(_same("n") & _same("s") & _same("w") & _same("e"))).select(*KEYS, "row", "col")
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(own).alias("own"), F.lit(beside).alias("beside"))
                        for dr, own, beside in ((-1, 2, 10), (0, 1, 2), (1, 2, 10))])
    reach = border.select(*KEYS, "row", "col", F.inline(offsets)).select(*KEYS, (F.col("row") + F.col("dr")).alias("row"), "col", "own", "beside")
    sums = reach.groupBy(*KEYS, "row", "col").agg(F.sum("own").alias("own"), F.sum("beside").alias("beside"))
    line = Window.partitionBy(*KEYS, "row").orderBy("col")
    near = [F.when(at("col").over(line) == F.col("col") + d, at("beside").over(line)).otherwise(0) for at, d in ((F.lag, -1), (F.lead, 1))]
    codes = sums.select(*KEYS, (F.col("own") + near[0] + near[1]).alias("code"))
    length = F.lit(0.0)
    for code, value in BORDER_LENGTHS.items():  # only border pixels have odd codes
        length = F.when(F.col("code") == code, F.lit(value)).otherwise(length)
    return codes.groupBy(*KEYS).agg(F.sum(length).alias("perimeter"))


def _quad_twelfths() -> Column:
    """A pixel's part of 4 x 3 times the Euler number: each 2x2 quad around it counts 3 when the pixel is
    alone, -1 when one of four is missing, -3 when only the opposite pixel is there (eight-connected)."""
    terms = []
    for side, ahead, corner in (("w", "n", "nw"), ("e", "n", "ne"), ("w", "s", "sw"), ("e", "s", "se")):
        a, b, d = (f"({x} <=> segment)" for x in (side, ahead, corner))
        terms.append(f"case when not {a} and not {b} then if({d}, -3, 3) when {a} and {b} and not {d} then -1 "
                     f"when {a} != {b} and {d} then -1 else 0 end")
    return F.expr(" + ".join(terms))


def euler_numbers(around: DataFrame) -> DataFrame:
    """(filename, segment, euler_number): parts minus holes."""
    return around.groupBy(*KEYS).agg(_euler())


def _euler() -> Column:
    return (F.sum(_quad_twelfths()) / 12).cast("int").alias("euler_number")


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _half_hull(points):
    hull = []
    for p in points:
        while len(hull) >= 2 and _cross(hull[-2], hull[-1], p) <= 0:
            hull.pop()
        hull.append(p)
    return hull


def _hull(y: np.ndarray, x: np.ndarray):
    """The lower and the upper chain of the convex hull of points."""
    points = sorted(set(zip(y.tolist(), x.tolist())))
    return _half_hull(points), _half_hull(points[::-1])[::-1]


def _hull_of_lines(rows, low, high):
    """Corners (y, x) of the hull of the edge midpoints of lines of pixels."""
    y = np.concatenate([rows, rows, rows - 0.5, rows + 0.5, rows - 0.5, rows + 0.5])
    x = np.concatenate([low - 0.5, high + 0.5, low, low, high, high])
    lower, upper = _hull(y, x)
    corners = np.array(lower + upper)
    return corners[:, 0], corners[:, 1]


def _hull_pixels(y: np.ndarray, x: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of points."""
    lower, upper = _hull(y, x)
    lines = np.arange(math.ceil(y.min()), math.floor(y.max()) + 1)
    sides = [np.interp(lines, [p[0] for p in side], [p[1] for p in side]) for side in (lower, upper)]
    left, right = np.minimum(*sides), np.maximum(*sides)
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def _first_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below ``n`` that each one hangs together with by the pairs."""
    parent = np.arange(n)
    while True:
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, before[a], low)
        np.minimum.at(parent, before[b], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        if (parent == before).all():
            return parent


def _gaps(rows, starts, ends, block: int, size: int):
    """What the gaps between a block's runs add to the holes: the pixels of groups of gaps that are closed within the block,
    and for the others (group, gap, pixels, outside), a row per gap on a line that two blocks know.

    A gap leads outside where the line above or below does not reach over it. ``rows`` may hold the lines before and after
    the block's own; their gaps only tie groups together.
    """
    lines, first = np.unique(rows, return_index=True)
    low, high = np.minimum.reduceat(starts, first), np.maximum.reduceat(ends, first)
    inside = rows[1:] == rows[:-1]
    row, left, right = rows[1:][inside], ends[:-1][inside] + 1, starts[1:][inside] - 1
    own = row // size == block
    if not own.any():
        return 0, *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    outside = np.zeros(len(row), bool)
    for other in (row - 1, row + 1):
        at = np.minimum(np.searchsorted(lines, other), len(lines) - 1)
        outside |= (lines[at] != other) | (left < low[at]) | (right > high[at])
    outside &= own
    # gaps of the next line that overlap: neither ends before this one, nor begins after it
    since = np.searchsorted(row * PLACE + right, (row + 1) * PLACE + left)
    n = np.maximum(np.searchsorted(row * PLACE + left, (row + 1) * PLACE + right, "right") - since, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(since, n)
    group = _first_of_each(len(row), a, b)
    pixels = np.bincount(group, np.where(own, right - left + 1, 0), len(row)).astype(np.int64)
    leads = np.bincount(group, outside, len(row)) > 0
    known = (row > 0) & ((row % size == 0) | (row % size == size - 1))  # lines that the next or the last block has too
    least = np.full(len(row), len(row))
    np.minimum.at(least, group[known], np.flatnonzero(known))
    closed = (np.arange(len(row)) == group) & (least == len(row)) & ~leads
    gap = np.flatnonzero(known)
    head = least[group[gap]]
    number = row * PLACE + left
    return int(pixels[closed].sum()), number[head], number[gap], np.where(head == gap, pixels[group[gap]], 0), leads[group[gap]]


#: Lines of a block: what a task holds of a segment at a time is the runs of one block. Gaps are numbered row * PLACE + col.
LINES = 256
PLACE = 1 << 31
_BLOCK = "y array<double>, x array<double>, closed bigint, head array<bigint>, gap array<bigint>, pixels array<bigint>, outside array<boolean>"


def _block_outline(size: int):
    @F.pandas_udf(_BLOCK)
    def outline(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blocks, *runs in parts:
            found = []
            for block, *run in zip(blocks, *runs):
                rows, starts, ends = (np.asarray(v, dtype=np.int64) for v in run)
                lines, first = np.unique(rows, return_index=True)
                y, x = _hull_of_lines(lines, np.minimum.reduceat(starts, first), np.maximum.reduceat(ends, first))
                found.append((y, x, *_gaps(rows, starts, ends, block, size)))
            yield pd.DataFrame(found, columns=["y", "x", "closed", "head", "gap", "pixels", "outside"])
    return outline


@F.pandas_udf(LongType())
def _convex_area(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ys, xs in parts:
        yield pd.Series([_hull_pixels(np.asarray(y), np.asarray(x)) for y, x in zip(ys, xs)], dtype="int64")


def _open_holes(blocks: DataFrame) -> DataFrame:
    """(filename, segment, open): pixels of holes that lie in more than one block of lines."""
    met = checkpoint(blocks.select(*KEYS, F.inline(F.arrays_zip("b.head", "b.gap", "b.pixels", "b.outside"))))
    groups = met.groupBy(*KEYS, F.col("head").alias("node")).agg(F.sum("pixels").alias("pixels"), F.max("outside").alias("outside"))
    edges = met.where("head <> gap").select("filename", F.col("head").alias("n1"), F.col("gap").alias("n2"))
    if edges.isEmpty():
        whole = groups.withColumnRenamed("node", "component")
    else:  # a gap follows a pixel of its segment, so its number is of one segment only
        nodes = met.select("filename", F.col("head").alias("node")).union(met.select("filename", "gap"))
        whole = join_keyed(groups, connected_components(nodes, edges, "filename", "node"), ["filename", "node"])
    whole = whole.groupBy(*KEYS, "component").agg(F.sum("pixels").alias("pixels"), F.max("outside").alias("outside"))
    return whole.where("not outside").groupBy(*KEYS).agg(F.sum("pixels").alias("open"))


def outlines(around: DataFrame, lines_per_block: int = LINES) -> DataFrame:
    """(filename, segment, area, filled_area, convex_area, solidity, euler_number).

    A segment is reduced to its horizontal runs, found where a neighbour differs, and these to blocks of lines: a
    block gives the corners of its hull, the pixels of holes that close within it, and the groups of gaps that touch a line
    which the next block has too. The corners of all blocks (few, as they are corners on a grid) give the hull; groups are
    tied together by their common gaps. So however large a segment is, no task holds more than a block of it.
    """
    def ordered(edge):
        return F.sort_array(F.collect_list(F.when(~_same(edge), F.col("col"))))

    lines = around.groupBy(*KEYS, F.col("row").cast("long").alias("row")).agg(
        F.count("*").alias("n"), F.sum(_quad_twelfths()).alias("q"), ordered("w").alias("from"), ordered("e").alias("to"))
    near = F.array_distinct(F.array(*[F.floor((F.col("row") + i) / lines_per_block) for i in (-1, 0, 1)]))
    lines = lines.withColumn("block", F.explode(near))
    own = F.floor(F.col("row") / lines_per_block) == F.col("block")
    blocks = lines.groupBy(*KEYS, "block").agg(
        F.sum(F.when(own, F.col("n"))).alias("n"), F.sum(F.when(own, F.col("q"))).alias("q"),
        F.sort_array(F.collect_list(F.struct("row", "from", "to"))).alias("r")).where("n > 0")
    rows = F.flatten(F.transform("r", lambda x: F.array_repeat(x["row"], F.size(x["from"]))))
    return _whole_outlines(blocks.select(*KEYS, "block", "n", "q", rows.alias("rows"), F.flatten("r.from").alias("from"),
                                         F.flatten("r.to").alias("to")), lines_per_block)


def _whole_outlines(blocks: DataFrame, lines_per_block: int, *sums: str) -> DataFrame:
    """What ``outlines`` gives, and the sums of further columns, from the runs of each block of lines: (filename, segment, block,
    pixels ``n``, twelfths ``q`` of the Euler number, ``rows``, ``from`` and ``to`` of the runs in order)."""
    blocks = checkpoint(blocks.select(*KEYS, "n", "q", *sums, _block_outline(lines_per_block)("block", "rows", "from", "to").alias("b")))
    whole = blocks.groupBy(*KEYS).agg(
        F.sum("n").alias("area"), (F.sum("q") / 12).cast("int").alias("euler_number"), F.sum("b.closed").alias("closed"),
        F.collect_list(F.struct("b.y", "b.x")).alias("hull"), *[F.sum(c).alias(c) for c in sums])
    whole = whole.withColumn("convex_area", _convex_area(F.flatten("hull.y"), F.flatten("hull.x")))
    out = join_keyed(whole, _open_holes(blocks), KEYS, "left")
    return out.select(*KEYS, "area", (F.col("area") + F.col("closed") + F.coalesce("open", F.lit(0))).alias("filled_area"),
                      "convex_area", (F.col("area") / F.col("convex_area")).alias("solidity"), "euler_number", *sums)


#: Pixels that a task gets, about.
TASK_PIXELS = 1 << 20
_ENDS = PLACE // 2  # the ends of runs are numbered row * PLACE + _ENDS + col
_LENGTHS = np.array([BORDER_LENGTHS.get(code, 0.0) for code in range(50)])
# lines down and columns right to each neighbour
_STEPS = {"w": (0, -1), "e": (0, 1), "n": (-1, 0), "s": (1, 0), "nw": (-1, -1), "se": (1, 1), "ne": (-1, 1), "sw": (1, -1)}


def _tile_runs(size: int, lines_per_block: int):
    """Arrow function on the pixels of whole tiles and of the two lines around each: a row per segment, tile and block of lines with
    what its pixels add to area, Euler number and perimeter, and where runs begin and end there."""
    def run(table: pa.Table) -> pa.Table:
        image, segment = codes(table.column("filename")), codes(table.column("segment"))
        row, col, tr, tc = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "__tr", "__tc"))
        order = np.lexsort((col, row, tc, tr, image))
        image, segment, row, col, tr, tc = (x[order] for x in (image, segment, row, col, tr, tc))
        starts = run_starts(image, tr, tc)
        tile = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(image)))
        high, wide = row + 2 - tr * size, col + 2 - tc * size  # from 0 to size - 1 within the tile itself
        own = (high >= 0) & (high < size) & (wide >= 0) & (wide < size)
        line = size + 6
        place = (tile * line + high + 3) * line + wide + 3
        last = len(place) - 1
        same, at = {}, {}
        for name, (down, right) in _STEPS.items():
            if name in ("w", "e"):
                at[name] = np.arange(len(place)) + right
            else:
                at[name] = np.searchsorted(place, place + down * line + right)
            at[name] = np.clip(at[name], 0, last)
            same[name] = (place[at[name]] == place + down * line + right) & (segment[at[name]] == segment)
        border = ~(same["n"] & same["s"] & same["w"] & same["e"])
        code = 1 + sum((2 if 0 in step else 10) * (same[name] & border[at[name]]) for name, step in _STEPS.items())
        length = np.where(border, _LENGTHS[code], 0.0)
        quads = np.zeros(len(place), np.int64)
        for side, ahead, corner in (("w", "n", "nw"), ("e", "n", "ne"), ("w", "s", "sw"), ("e", "s", "se")):
            a, b, d = same[side], same[ahead], same[corner]
            quads += np.where(~a & ~b, np.where(d, -3, 3), np.where(a & b & ~d | (a != b) & d, -1, 0))
        # a block knows the lines before and after its own too
        parts = []
        for step in (0, -1, 1):
            block = (row + step) // lines_per_block
            kept = np.flatnonzero(own if not step else own & (block != row // lines_per_block))
            parts.append((kept, block[kept], np.full(len(kept), step == 0)))
        pixel, block, whole = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pixel, block, segment[pixel], tile[pixel]))
        pixel, block, whole = pixel[order], block[order], whole[order]
        first = run_starts(tile[pixel], segment[pixel], block)
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(pixel)))

        def ends(side):
            found = ~same[side][pixel]
            number = row[pixel[found]] * PLACE + _ENDS + col[pixel[found]]
            return pa.ListArray.from_arrays(np.searchsorted(group[found], np.arange(len(first) + 1)).astype(np.int32), pa.array(number))

        def total(x, kind):
            return pa.array(np.bincount(group, np.where(whole, x[pixel], 0), len(first)).astype(kind))

        names, labels = ((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column) for column in
                         (pc.unique(table.column(c)) for c in KEYS))
        head = pixel[first]
        return pa.table([names.take(pa.array(image[head])), labels.take(pa.array(segment[head])), pa.array(block[first]),
                         total(np.ones(len(place)), np.int64), total(quads, np.int64), total(length, float), ends("w"), ends("e")],
                        names=[*KEYS, "block", "n", "q", "perimeter", "from", "to"])
    return run


def outline_properties(px: DataFrame, lines_per_block: int = LINES, size: int = TILE) -> DataFrame:
    """Perimeter, Euler number, filled and convex area and solidity per segment.

    Pixels move once, to the tile that holds them and to those within two lines of them; a task works on one tile, or on many
    small images at once, and the number of tasks follows the number of pixels. Only the ends of runs and sums go on.
    """
    px = px.select(*KEYS, "row", "col")
    tasks = -(-px.count() // TASK_PIXELS)
    schema = px.selectExpr(*KEYS, "0L as block", "0L as n", "0L as q", "0D as perimeter", "array(0L) as `from`", "array(0L) as `to`").schema
    for c, t in (("row", "__tr"), ("col", "__tc")):
        # tiles end beside line -2, so that an image that begins at 0 has no pixels in tiles before it
        around = (F.floor((F.col(c) + 2 + d) / size).cast("int") for d in (-2, 2))
        px = px.withColumn(t, F.explode(F.sequence(*around)))
    tiles = map_groups(px, ["filename", "__tr", "__tc"], _tile_runs(size, lines_per_block), schema, tasks)
    blocks = tiles.groupBy(*KEYS, "block").agg(*[F.sum(c).alias(c) for c in ("n", "q", "perimeter")], *[
        F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("from", "to")]).where("n > 0")
    bits = PLACE.bit_length() - 1
    column = f"x -> (x & {PLACE - 1}L) - {_ENDS}L"
    blocks = blocks.selectExpr(*KEYS, "block", "n", "q", "perimeter", f"transform(`from`, x -> shiftright(x, {bits})) as rows",
                               f"transform(`from`, {column}) as `from`", f"transform(`to`, {column}) as `to`")
    return _whole_outlines(blocks, lines_per_block, "perimeter")
