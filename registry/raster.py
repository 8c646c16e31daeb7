"""Queries over pixel tables."""

import pandas as pd
from pyspark.sql import functions as F

from mlframes.functions import colour, dates, indices
from mlframes.operators.raster import KEYS, features, regions, shape, superpixel, wide
from mlframes.plans.joins import join_shuffled
from registry.base import cte, fixture, pixels, query, rd, rounded

PX = cte("pixels")


def _div(a: str, b: str) -> str:
    return f"({a})/nullif({b},0)"


INDEX_SQL = {
    "NDVI_r": _div("nir-red", "nir+red"), "NDVI_g": _div("nir-green", "nir+green"), "NDVI_b": _div("nir-blue", "nir+blue"),
    "EVI": "2.5::double*" + _div("nir-red", "nir+6*red-7.5::double*blue+1"),
    "SAVI": "1.5::double*" + _div("nir-red", "nir+red+0.5::double"),
    "MSAVI": "(2*nir+1-sqrt(case when (2*nir+1)*(2*nir+1)-8*(nir-red)>=0 then (2*nir+1)*(2*nir+1)-8*(nir-red) end))/2.0::double",
    "NDWI": _div("green-nir", "green+nir")}

_INDEXED = f"{PX}, ix as (select *, {', '.join(f'{e} as {n}' for n, e in INDEX_SQL.items())} from pixels)"


@query("f02_day_fraction", f"""{cte('catalogue')} select filename, {rd("dayofyear(strptime(date,'%Y%m%d'))/365.0::double", 9)} as day_of_year from catalogue""")
def f02(spark, sf):
    return rounded(fixture(spark, sf, "catalogue").select("filename", dates.day_fraction(dates.image_date()).alias("day_of_year")), 9)


@query("p07_image_date", f"""{cte('catalogue')} select filename, img_path, strptime(date,'%Y%m%d')::date as img_date from catalogue""")
def p07(spark, sf):
    return fixture(spark, sf, "catalogue").select("filename", "img_path", dates.image_date().alias("img_date"))


@query("f03_band_indices", f"""{_INDEXED} select filename, {', '.join(f'count({n}) as n_{n}, {rd(f"avg({n})", 7)} as {n}' for n in INDEX_SQL)}
    from ix group by 1""")
def f03(spark, sf):
    ix = indices.with_indices(pixels(spark, sf))
    return rounded(ix.groupBy("filename").agg(*[a for n in INDEX_SQL for a in (F.count(n).alias(f"n_{n}"), F.avg(n).alias(n))]), 7)


@query("f04_pixel_ratios", f"""{PX}, s as (select filename, blue/65535 as b, green/65535 as g, red/65535 as r, nir/65535 as n from pixels where red<>0)
    select filename, {rd('avg(n/(r+1))', 9)} as sr, {rd('avg(2.5::double*((n-r)/(1+n+6*r-7.5::double*b)+1))', 9)} as evi,
    {rd('avg(n/(g+1)-1)', 9)} as cl_green, {rd('avg((n-b)/((b-r)+1))', 9)} as mtci from s group by 1""")
def f04(spark, sf):
    px = pixels(spark, sf).where(colour.valid())
    b, g, r, n = (colour.scaled(c) for c in ("blue", "green", "red", "nir"))
    return rounded(px.groupBy("filename").agg(
        F.avg(indices.simple_ratio(n, r)).alias("sr"), F.avg(indices.enhanced_ratio(n, r, b)).alias("evi"),
        F.avg(indices.chlorophyll(n, g)).alias("cl_green"), F.avg(indices.mtci(n, b, r)).alias("mtci")), 9)


def _colour_steps(scale: str) -> str:
    """CTEs from ``pixels`` to ``lab``: per valid pixel h s v x y z l a b."""
    lin = lambda c: f"(case when {c}>0.04045::double then pow(({c}+0.055::double)/1.055::double,2.4::double) else {c}/12.92::double end)"
    f = lambda t: f"(case when {t}>0.008856::double then pow({t},1.0::double/3.0::double) else {t}*7.787::double+16.0::double/116.0::double end)"
    m = [[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]
    xyz = ", ".join(f"{lin('red')}*{a}::double+{lin('green')}*{b}::double+{lin('blue')}*{c}::double as {n}" for (a, b, c), n in zip(m, "xyz"))
    return f"""sc as (select filename, segment, blue/{scale} as blue, green/{scale} as green, red/{scale} as red, nir/{scale} as nir
        from pixels where red<>0),
      hv as (select *, greatest(red,green,blue) as v, greatest(red,green,blue)-least(red,green,blue) as sp, {xyz} from sc),
      hs as (select *, coalesce(sp/nullif(v,0),0) as s, (case when blue=v then (red-green)/nullif(sp,0)+4
        when green=v then (blue-red)/nullif(sp,0)+2 else (green-blue)/nullif(sp,0) end)/6 as t from hv),
      lb as (select *, coalesce(t-floor(t),0) as h, {f('(x/0.95047::double)')} as fx, {f('y')} as fy, {f('(z/1.08883::double)')} as fz from hs),
      lab as (select *, fy*116-16 as l, (fx-fy)*500 as a, (fy-fz)*200 as b from lb)"""


_BANDS13 = ["red", "green", "blue", "nir", *"hsvlabxyz"]


@query("f05_colour_conversion", f"""{PX}, {_colour_steps('65535')} select filename, count(*) as n,
    {', '.join(f'{rd(f"avg({c})", 9)} as {c}' for c in _BANDS13)} from lab group by 1""")
def f05(spark, sf):
    bands = features.spectral_bands(pixels(spark, sf)).where("red is not null")
    return rounded(bands.groupBy("filename").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _BANDS13]), 9)


@query("f09_ratio_statistics", f"""{PX}, r as (select filename, segment, (red-green)/nullif(blue,0) as a, (red+green+blue)/3 as g from pixels)
    select filename, segment, {rd('stddev_pop(a)')} as rgb_sd, {rd('avg(a)')} as rgb_mean, {rd('stddev_pop(g)')} as gray_sd,
    {rd('avg(g)')} as gray_mean from r group by 1,2""")
def f09(spark, sf):
    return rounded(features.ratio_statistics(pixels(spark, sf)))


@query("r01_segment_pixels", f"{PX} select filename, segment, count(*) as n from pixels group by 1,2")
def r01(spark, sf):
    return features.segment_pixels(pixels(spark, sf))


_SPECTRAL = ["SR", "CL_green", "normalized_R", "normalized_G", "normalized_B", "mean_R_by_B", "mean_R_by_B_plus_R",
             "mean_chroma", "R-G", "R-B", "G-R", "G-B", "B-R", "B-G"]


@query("r02_spectral_features", f"""{cte('pixels', 'catalogue')}, {_colour_steps('65535')}
    select filename, segment, {rd("max(dayofyear(strptime(date,'%Y%m%d')))/365.0::double", 9)} as day_of_year,
    {rd('avg(nir/(red+1))', 9)} as "SR", {rd('avg(nir/(green+1)-1)', 9)} as "CL_green",
    {', '.join(f'{rd(f"avg({c}/(red+green+blue+1))", 9)} as "normalized_{c[0].upper()}"' for c in ('red', 'green', 'blue'))},
    {rd('avg(red/(blue+1))', 9)} as "mean_R_by_B", {rd('avg(red/(blue+red+1))', 9)} as "mean_R_by_B_plus_R",
    {rd('greatest(max(red),max(green),max(blue))-least(min(red),min(green),min(blue))', 9)} as mean_chroma,
    {', '.join(f'{rd(f"avg({p}-{q})", 9)} as "{p[0].upper()}-{q[0].upper()}"' for p in ('red', 'green', 'blue') for q in ('red', 'green', 'blue') if p != q)}
    from lab join catalogue using (filename) group by 1,2""")
def r02(spark, sf):
    px = pixels(spark, sf)
    out = features.spectral_features(px, fixture(spark, sf, "catalogue"))
    return rounded(out.select(*KEYS, "day_of_year", *[F.col(f"`{c}`") for c in _SPECTRAL]), 9)


def _list_quantile(c: str, p: float) -> str:
    """Linear interpolation in the sorted list ``<c>_l``, from the nearer end."""
    at = f"((len({c}_l)-1)*{p}::double)"
    lo, hi, t = f"{c}_l[floor({at})::int+1]", f"{c}_l[ceil({at})::int+1]", f"({at}-floor({at}))"
    return f"(case when {t}<0.5 then {lo}+({hi}-{lo})*{t} else {hi}-({hi}-{lo})*(1-{t}) end)"


@query("r03_interquartile_means", f"""{PX}, {_colour_steps('65535')},
    sorted as (select filename, segment, {', '.join(f'list_sort(list({c})) as {c}_l' for c in _BANDS13)} from lab group by 1,2),
    q as (select filename, segment, {', '.join(f'{_list_quantile(c, 0.25)} as {c}_p, {_list_quantile(c, 0.75)} as {c}_q' for c in _BANDS13)}
      from sorted)
    select filename, segment, {', '.join(f'{rd(f"avg({c}) filter ({c}>{c}_p and {c}<{c}_q)", 8)} as {c}_mean' for c in _BANDS13)}
    from lab join q using (filename, segment) group by 1,2""")
def r03(spark, sf):
    out = features.spectral_features(pixels(spark, sf))
    return rounded(out.select(*KEYS, *[f"{c}_mean" for c in _BANDS13]), 8)


@query("r04_image_means", f"""{PX}, {_colour_steps('65535')} select filename, {', '.join(f'{rd(f"avg({c})", 9)} as image_mean_{c}' for c in _BANDS13)},
    {rd('avg(l)', 9)} as image_mean_cl, {rd('avg(a)', 9)} as image_mean_ca, {rd('avg(b)', 9)} as image_mean_cb from lab group by 1""")
def r04(spark, sf):
    out = features.spectral_features(pixels(spark, sf))
    return rounded(out.select("filename", *[f"image_mean_{c}" for c in [*_BANDS13, "cl", "ca", "cb"]]).distinct(), 9)


_STAT_SQL = {"min": "min({0})", "max": "max({0})", "std": "stddev_pop({0})", "mean": "avg({0})", "median": "median({0})"}
_R05_COLUMNS = ", ".join(f"{rd(e.format(q), 7)} as {q}_{s}" for q in features.QUANTITIES for s, e in _STAT_SQL.items())


@query("r05_index_features", f"{_INDEXED} select filename, segment, {_R05_COLUMNS} from ix group by 1,2")
def r05(spark, sf):
    return rounded(features.index_features(pixels(spark, sf)), 7)


def _colour_sql(keys: str, name: str, green: str = "green") -> str:
    return f"""select {keys}, {rd('sqrt(pow(stddev_pop(rg),2)+pow(stddev_pop(yb),2))+0.3::double*sqrt(pow(avg(rg),2)+pow(avg(yb),2))')} as {name}
    from (select *, abs(red-{green}) as rg, abs(0.5::double*(red+{green})-blue) as yb from pixels) group by all"""


@query("r06_image_colourfulness", f"{PX} {_colour_sql('filename', 'img_colorfulness')}")
def r06(spark, sf):
    return rounded(features.image_colourfulness(pixels(spark, sf)))


@query("r07_segment_colourfulness", f"{PX} {_colour_sql('filename, segment', 'seg_colorfulness')}")
def r07(spark, sf):
    return rounded(features.segment_colourfulness(pixels(spark, sf)))


@query("r07_segment_colourfulness_legacy", f"{PX} {_colour_sql('filename, segment', 'seg_colorfulness', 'blue')}")
def r07l(spark, sf):
    return rounded(features.segment_colourfulness(pixels(spark, sf), legacy_green=True))


_O = shape.ORDERS


def _region_sql() -> str:
    """Region properties by definition: a second pass centres rows and columns before taking powers."""
    def pw(v, n):
        return "*".join([v] * n) if n else "1.0::double"

    def moments(prefix, r, c, w="1.0::double"):
        return ", ".join(f"sum({w}*{pw(r, p)}*{pw(c, q)}) as {prefix}{p}{q}" for p, q in _O)

    def norm(prefix, out):
        return ", ".join((f"{prefix}{p}{q}/nullif(pow({prefix}00,{(p + q) / 2 + 1}::double),0)" if p + q > 1 else "null::double")
                         + f" as {out}{p}{q}" for p, q in _O)

    def hu(n):
        a, b = f"({n}30+{n}12)", f"({n}21+{n}03)"
        c, d = f"({n}30-3*{n}12)", f"(3*{n}21-{n}03)"
        return [f"{n}20+{n}02", f"pow({n}20-{n}02,2)+4*{n}11*{n}11", f"{c}*{c}+{d}*{d}", f"{a}*{a}+{b}*{b}",
                f"{c}*{a}*({a}*{a}-3*{b}*{b})+{d}*{b}*(3*{a}*{a}-{b}*{b})",
                f"({n}20-{n}02)*({a}*{a}-{b}*{b})+4*{n}11*{a}*{b}",
                f"{d}*{a}*({a}*{a}-3*{b}*{b})-{c}*{b}*(3*{a}*{a}-{b}*{b})"]

    def arr(prefix, digits):
        return "[" + ", ".join(rd(f"{prefix}{p}{q}", digits) for p, q in _O) + "]"

    intensities = ", ".join(f"{rd(f'max({s}_{n}_i)', 5)} as {n}_{s}_intensity" for n in ("gray", "red", "green", "blue")
                            for s in ("min", "mean", "max"))
    return f"""{PX}, g as (select *, blue*0.299::double+green*0.587::double+red*0.114::double as gray, "row"::double as r, col::double as c from pixels),
    base as (select filename, segment, count(*) as area, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1, avg(r) as cy, avg(c) as cx,
      sum(gray*r)/nullif(sum(gray),0) as wy, sum(gray*c)/nullif(sum(gray),0) as wx,
      {', '.join(f'min({n}) as min_{n}_i, avg({n}) as mean_{n}_i, max({n}) as max_{n}_i' for n in ('gray', 'red', 'green', 'blue'))} from g group by 1,2),
    j as (select g.*, b.* exclude (filename, segment), g.r-r0 as lr, g.c-c0 as lc, g.r-cy as mr, g.c-cx as mc, g.r-wy as vr, g.c-wx as vc
      from g join base b on b.filename=g.filename and b.segment=g.segment),
    m as (select filename, segment, {moments('a', 'lr', 'lc')}, {moments('k', 'mr', 'mc')}, {moments('v', 'lr', 'lc', 'gray')},
      {moments('u', 'vr', 'vc', 'gray')}, max(area) as area, max(r0) as r0, max(r1) as r1, max(c0) as c0, max(c1) as c1, max(cy) as cy,
      max(cx) as cx, max(wy) as wy, max(wx) as wx, {intensities} from j group by 1,2),
    n as (select *, {norm('k', 'e')}, {norm('u', 'f')}, k02/k00 as ta, -k11/k00 as tb, k20/k00 as tc from m),
    z as (select *, greatest((ta+tc)/2+sqrt(pow(ta-tc,2)/4+tb*tb),0) as l1, greatest((ta+tc)/2-sqrt(pow(ta-tc,2)/4+tb*tb),0) as l2 from n)
    select filename, segment, segment as label, area, [r0::int, c0::int, r1::int+1, c1::int+1] as bbox,
      ((r1-r0+1)*(c1-c0+1))::bigint as bbox_area, {rd('cy', 5)} as centroid_y, {rd('cx', 5)} as centroid_x, {rd('cy-r0', 5)} as local_centroid_y,
      {rd('cx-c0', 5)} as local_centroid_x, {rd('area/((r1-r0+1)*(c1-c0+1))', 5)} as extent, {rd('sqrt(4*area/pi())', 5)} as equivalent_diameter,
      {arr('a', 2)} as moments, {arr('k', 2)} as moments_central, {arr('e', 5)} as moments_normalized,
      [{', '.join(rd(h, 5) for h in hu('e'))}] as moments_hu, [{rd('ta', 5)}, {rd('tb', 5)}, {rd('tb', 5)}, {rd('tc', 5)}] as inertia_tensor,
      [{rd('l1', 5)}, {rd('l2', 5)}] as inertia_tensor_eigvals, {rd('4*sqrt(l1)', 5)} as major_axis_length, {rd('4*sqrt(l2)', 5)} as minor_axis_length,
      {rd('case when l1=0 then 0 else sqrt(greatest(1-l2/l1,0)) end', 5)} as eccentricity,
      {rd('case when abs(ta-tc)<=1e-9*(ta+tc) then (case when tb<-1e-9*(ta+tc) then pi()/4 else -pi()/4 end) else 0.5::double*atan2(case when abs(tb)<=1e-9*(ta+tc) then 0.0::double else -2*tb end, tc-ta) end', 5)} as orientation,
      [{rd('wy', 5)}, {rd('wx', 5)}] as weighted_centroid, [{rd('wy-r0', 5)}, {rd('wx-c0', 5)}] as weighted_local_centroid,
      {arr('v', 2)} as weighted_moments, {arr('u', 2)} as weighted_moments_central, [{', '.join(rd(h, 5) for h in hu('f'))}] as weighted_moments_hu,
      {', '.join(f'{n}_{s}_intensity' for n in ('gray', 'red', 'green', 'blue') for s in ('min', 'mean', 'max'))} from z"""


def _round_regions(df):
    """Two digits for the large moments, five for the rest."""
    large = ["moments", "moments_central", "weighted_moments", "weighted_moments_central"]
    return rounded(df, 5, dict.fromkeys(large, 2))


@query("r09_region_properties", _region_sql())
def r09(spark, sf):
    return _round_regions(shape.region_properties(pixels(spark, sf)))


@query("r09_region_properties_far", _region_sql())
def r09_far(spark, sf):
    """The same segments far from the corner of a large image: whatever names a place moves back, all else must be as near the corner."""
    far = shape.region_properties(pixels(spark, sf).withColumns({"row": F.col("row") + 20_480, "col": F.col("col") + 30_720}))
    back = {"centroid_y": F.col("centroid_y") - 20_480, "centroid_x": F.col("centroid_x") - 30_720,
            "bbox": F.zip_with("bbox", F.array(*map(F.lit, (20_480, 30_720, 20_480, 30_720))), lambda a, b: a - b),
            "weighted_centroid": F.zip_with("weighted_centroid", F.array(F.lit(20_480), F.lit(30_720)), lambda a, b: a - b)}
    return _round_regions(far.withColumns(back))


# a column or more of every part of the segment table
_FEATURE_COLUMNS = ["red_mean_x", "nir_median", "NDVI_r_std", "seg_colorfulness", "area", "extent", "major_axis_length", "gray_mean_intensity",
                    "perimeter", "euler_number", "solidity", "day_of_year", "SR", "mean_chroma", "image_mean_red"]
_FEATURE_BODY = f"""d as (select *, blue/65535 as sb, green/65535 as sg, red/65535 as sr, nir/65535 as sn, abs(red-green) as rg,
      abs(0.5::double*(red+green)-blue) as yb, (nir-red)/nullif(nir+red,0) as ndvi from pixels),
    whole as (select filename, avg(sr) as image_red from d where red<>0 group by 1),
    f as (select filename, segment, avg(red) as red_mean_x, median(nir) as nir_median, stddev_pop(ndvi) as "NDVI_r_std",
      sqrt(pow(stddev_pop(rg),2)+pow(stddev_pop(yb),2))+0.3::double*sqrt(pow(avg(rg),2)+pow(avg(yb),2)) as seg_colorfulness, count(*) as area,
      1.0::double as extent, 4*sqrt(greatest(var_pop("row"),var_pop(col))) as major_axis_length,
      avg(blue*0.299::double+green*0.587::double+red*0.114::double) as gray_mean_intensity,
      2.0::double*(max("row")-min("row"))+2.0::double*(max(col)-min(col)) as perimeter, 1::int as euler_number, 1.0::double as solidity,
      max(dayofyear(strptime(date,'%Y%m%d')))/365.0::double as day_of_year, avg(sn/(sr+1)) filter (red<>0) as "SR",
      greatest(max(sr) filter (red<>0),max(sg) filter (red<>0),max(sb) filter (red<>0))
        -least(min(sr) filter (red<>0),min(sg) filter (red<>0),min(sb) filter (red<>0)) as mean_chroma, max(image_red) as image_mean_red
      from d join catalogue using (filename) join whole using (filename) group by 1,2)"""
_FEATURE_SQL = f"""{cte('pixels', 'catalogue')}, {_FEATURE_BODY} select filename, segment, {', '.join(
    c if c in ('area', 'euler_number') else f'{rd(f'"{c}"', 7)} as "{c}"' for c in _FEATURE_COLUMNS)} from f"""


@query("r08_segment_features", _FEATURE_SQL)
def r08(spark, sf):
    return rounded(wide.segment_features(pixels(spark, sf), fixture(spark, sf, "catalogue")).select(*KEYS, *_FEATURE_COLUMNS), 7)


@query("r10_outline_properties", f"""{PX}, b as (select filename, segment, count(*) as area, max("row")-min("row")+1 as h, max(col)-min(col)+1 as w
      from pixels group by 1,2)
    select filename, segment, area, area as filled_area, area as convex_area, 1.0::double as solidity,
      {rd('2.0::double*(h-1)+2.0::double*(w-1)')} as perimeter, 1::int as euler_number from b""")
def r10(spark, sf):
    # the segments are rectangles: hull and filling change nothing, the perimeter runs through the border pixels
    return rounded(shape.outline_properties(pixels(spark, sf)))


_NODES = """nodes as (select filename, segment, count(*) as pixel_count, sum(blue) as tb, sum(green) as tg, sum(red) as tr,
      avg(blue) as mb, avg(green) as mg, avg(red) as mr from pixels group by 1,2)"""
_EDGES = f"""{_NODES}, touching as (select distinct a.filename, least(a.segment,b.segment) as n1, greatest(a.segment,b.segment) as n2
      from pixels a join pixels b on a.filename=b.filename and a.segment<>b.segment
      and ((b."row"=a."row" and b.col=a.col+1) or (b."row"=a."row"+1 and b.col between a.col-1 and a.col+1))
      where a.segment<>b.segment),
    edges as (select t.filename, n1, n2, sqrt(pow(x.mb-y.mb,2)+pow(x.mg-y.mg,2)+pow(x.mr-y.mr,2)) as weight from touching t
      join nodes x on x.filename=t.filename and x.segment=n1 join nodes y on y.filename=t.filename and y.segment=n2)"""


@query("r11_region_nodes", f"""{PX}, {_NODES} select filename, segment, pixel_count, {rd('tb')} as blue_total_color, {rd('tg')} as green_total_color,
    {rd('tr')} as red_total_color, {rd('mb')} as blue_mean_color, {rd('mg')} as green_mean_color, {rd('mr')} as red_mean_color from nodes""")
def r11n(spark, sf):
    return rounded(regions.region_nodes(pixels(spark, sf)))


@query("r11_region_edges", f"{PX}, {_EDGES} select filename, n1, n2, {rd('weight')} as weight from edges")
def r11e(spark, sf):
    return rounded(regions.region_edges(pixels(spark, sf)))


_DISTANCE = "sqrt(pow({a}b/{a}c-{b}b/{b}c,2)+pow({a}g/{a}c-{b}g/{b}c,2)+pow({a}r/{a}c-{b}r/{b}c,2))"


@query("r12_merge_regions", f"""{PX}, {_EDGES},
    first as (select filename, arg_min(n1, (weight, n1, n2)) as gone, arg_min(n2, (weight, n1, n2)) as kept from edges group by 1),
    home as (select n.filename, n.segment, case when segment=gone then kept else segment end as h from nodes n join first using (filename)),
    left3 as (select n.filename, h, sum(tb) as b, sum(tg) as g, sum(tr) as r, sum(pixel_count) as c, bool_or(h=kept) as fresh
      from nodes n join home using (filename, segment) join first using (filename) group by 1,2),
    pairs as (select x.filename, x.h as p, y.h as q, {_DISTANCE.format(a='x.', b='y.')} as w from left3 x join left3 y on x.filename=y.filename and x.h<>y.h
      where x.fresh or (not y.fresh and x.h<y.h)),
    second as (select filename, arg_min(p, (w, p, q)) as gone, arg_min(q, (w, p, q)) as kept from pairs group by 1),
    final as (select o.filename, segment, case when h=gone then kept else h end as h from home o join second using (filename))
    select filename, segment, (dense_rank() over (partition by filename order by h))::int as merged from final""")
def r12(spark, sf):
    # four segments that all touch become two: two merges, the second on the colours after the first
    px = pixels(spark, sf)
    nodes = regions.region_nodes(px)
    return regions.merge_regions(nodes, regions.region_edges(px, nodes), 2)


_CUT = f"""{_EDGES}, lim as (select filename, quantile_cont(weight, 0.5) as t from edges group by 1),
    kept as (select e.filename, n1, n2 from edges e join lim using (filename) where weight < t),
    both_ways as (select filename, n1 as a, n2 as b from kept union select filename, n2, n1 from kept),
    reach as (select filename, segment as s, segment as t from nodes union select filename, a, b from both_ways),
    r2 as (select x.filename, x.s, y.t from reach x join reach y on y.filename=x.filename and y.s=x.t group by all),
    r4 as (select x.filename, x.s, y.t from r2 x join r2 y on y.filename=x.filename and y.s=x.t group by all),
    comp as (select filename, s as segment, min(t) as component from r4 group by 1,2),
    means as (select filename, component, sum(tb)/sum(pixel_count) as blue_mean, sum(tg)/sum(pixel_count) as green_mean,
      sum(tr)/sum(pixel_count) as red_mean from nodes join comp using (filename, segment) group by 1,2)"""


@query("r13_threshold_regions", f"""{PX}, {_CUT} select filename, segment, component, {rd('blue_mean')} as blue_mean, {rd('green_mean')} as green_mean,
    {rd('red_mean')} as red_mean from comp join means using (filename, component)""")
def r13(spark, sf):
    # six edges between four segments: half of them stay, so that regions really join
    return rounded(regions.threshold_regions(pixels(spark, sf), 50.0))


@query("r14_superpixels", f"""select concat('img_', p_partkey::varchar) as filename, {16 * 16}::bigint as n_pixels, true as at_most_wanted,
    true as numbered_from_one, true as had_more from part""")
def r14(spark, sf):
    px = pixels(spark, sf).drop("segment")
    merged, original = superpixel.segment_images(px, n_segments=10, standardize=8)
    found = merged.groupBy("filename").agg(F.count("*").alias("n_pixels"), F.min("segment").alias("low"), F.max("segment").alias("high"),
                                           F.count_distinct("segment").alias("n"))
    return join_shuffled(found, original, ["filename"]).select(
        "filename", "n_pixels", (F.col("n") <= 8).alias("at_most_wanted"),
        ((F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("numbered_from_one"),
        (F.col("num_orig_segments") >= F.col("n")).alias("had_more"))


@query("r14_connected", f"""select concat('img_', p_partkey::varchar) as filename, {16 * 16}::bigint as n_pixels, true as one_piece_each,
    true as none_too_small from part""")
def r14c(spark, sf):
    found = superpixel.superpixels(pixels(spark, sf).drop("segment"), n_segments=10, sigma=1.0)

    def flooded(image: pd.DataFrame) -> pd.DataFrame:
        """Pieces by flooding one small image, another way than the operator's."""
        left = {(r, c): s for r, c, s in zip(image["row"], image["col"], image["segment"])}
        n, pieces, sizes = len(left), [], []
        while left:
            start = next(iter(left))
            label, todo, size = left.pop(start), [start], 0
            while todo:
                r, c = todo.pop()
                size += 1
                for at in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if left.get(at) == label:
                        del left[at]
                        todo.append(at)
            pieces.append(label)
            sizes.append(size)
        return pd.DataFrame({"filename": [image["filename"].iloc[0]], "n_pixels": [n], "one_piece_each": [len(set(pieces)) == len(pieces)],
                             "none_too_small": [min(sizes) >= n / 20 or len(sizes) == 1]})

    return found.groupBy("filename").applyInPandas(flooded, "filename string, n_pixels bigint, one_piece_each boolean, none_too_small boolean")


_GAUSS = "exp(-0.5::double*d*d)/(1+2*exp(-0.5::double)+2*exp(-2.0::double)+2*exp(-4.5::double)+2*exp(-8.0::double))"


# the weighted sum over both directions at once; mirrored at the border
@query("r14_smoothed", f"""{PX}, w as (select d, {_GAUSS} as w from range(-4, 5) t(d)),
    pairs as (select p.filename, p."row", p.col, a.w*b.w as w,
        case when p."row"+a.d<0 then -(p."row"+a.d)-1 when p."row"+a.d>15 then 31-(p."row"+a.d) else p."row"+a.d end as y,
        case when p.col+b.d<0 then -(p.col+b.d)-1 when p.col+b.d>15 then 31-(p.col+b.d) else p.col+b.d end as x from pixels p, w a, w b)
    select p.filename, p."row", p.col, {rd('sum(p.w*q.blue)')} as blue, {rd('sum(p.w*q.green)')} as green, {rd('sum(p.w*q.red)')} as red
    from pairs p join pixels q on q.filename=p.filename and q."row"=p.y and q.col=p.x group by 1, 2, 3""")
def r14s(spark, sf):
    return rounded(superpixel.smoothed(pixels(spark, sf).select("filename", "row", "col", "blue", "green", "red"), 1.0))


_CENTROIDS = """centroids as (select filename, segment, avg("row") as cy, avg(col) as cx from pixels group by 1,2)"""


@query("r15_edges_below", f"""{PX}, {_EDGES}, {_CENTROIDS} select e.filename, n1, n2, {rd('weight')} as weight, {rd('p.cy')} as y1, {rd('p.cx')} as x1,
    {rd('q.cy')} as y2, {rd('q.cx')} as x2 from edges e join centroids p on p.filename=e.filename and p.segment=n1
    join centroids q on q.filename=e.filename and q.segment=n2 where weight<20""")
def r15(spark, sf):
    px = pixels(spark, sf)
    return rounded(regions.edges_below(regions.region_edges(px), shape.segment_centroids(px), 20.0))


@query("r16_segment_centroids", f"{PX}, {_CENTROIDS} select filename, segment, {rd('cy')} as centroid_y, {rd('cx')} as centroid_x from centroids")
def r16(spark, sf):
    return rounded(shape.segment_centroids(pixels(spark, sf)))


_BANDS = ("blue", "green", "red", "nir")


@query("r18_clump_statistics", f"""{PX} select filename, segment, {', '.join(f'{rd(f"{f}({b})")} as {b}_{s}' for b in _BANDS for s, f in
    (('min', 'min'), ('max', 'max'), ('sum', 'sum'), ('mean', 'avg'), ('std', 'stddev_pop')))},
    (dense_rank() over (partition by filename order by segment))::int as segment_number from pixels group by 1,2""")
def r18(spark, sf):
    return rounded(features.clump_statistics(pixels(spark, sf)))


@query("w05_segment_mean_image", f"""{PX} select filename, "row", col, {', '.join(
    f'{rd(f"avg({b}) over (partition by filename, segment)")} as {b}_segment' for b in ('blue', 'green', 'red'))} from pixels""")
def w05(spark, sf):
    out = features.paint_segment_means(pixels(spark, sf))
    return rounded(out.select("filename", "row", "col", "blue_segment", "green_segment", "red_segment"))


_GRAY = "avg(blue*0.299::double+green*0.587::double+red*0.114::double)"


@query("w03_rank_segments", f"""{PX}, m as (select filename, segment, round({_GRAY}, 9) as gray_mean_intensity from pixels group by 1,2)
    select filename, segment, {rd('gray_mean_intensity')} as gray_mean_intensity,
    (row_number() over (partition by filename order by gray_mean_intensity desc, segment))::int as relabeled_segs from m""")
def w03(spark, sf):
    means = pixels(spark, sf).groupBy(*KEYS).agg(F.round(F.avg(colour.gray()), 9).alias("gray_mean_intensity"))
    return rounded(wide.rank_segments(means))


@query("j05_join_colour", f"""{PX}, i as (select filename, segment, avg(red) as red_mean from pixels group by 1,2),
    c as (select filename, segment, stddev_pop(red) as seg_colorfulness from pixels where blue>200 group by 1,2)
    select filename, segment, {rd('red_mean')} as red_mean, {rd('seg_colorfulness')} as seg_colorfulness from i left join c using (filename, segment)""")
def j05(spark, sf):
    px = pixels(spark, sf)
    index = px.groupBy(*KEYS).agg(F.avg("red").alias("red_mean"))
    some = px.where("blue > 200").groupBy(*KEYS).agg(F.stddev_pop("red").alias("seg_colorfulness"))
    return rounded(wide.join_colour(index, some))


@query("j06_join_segment_features", f"""{PX}, s as (select filename, segment, avg(red) as red_mean, max(nir) as nir_max, min(green) as g0, count(*) as area,
      avg(blue) as bm from pixels group by 1,2)
    select filename, segment, {rd('red_mean')} as red_mean_x, {rd('bm')} as seg_colorfulness, area, {rd('g0')} as red_mean_y from s""")
def j06(spark, sf):
    px = pixels(spark, sf)
    part = lambda *a: px.groupBy(*KEYS).agg(*a)
    return rounded(wide.join_segment_features(
        part(F.avg("red").alias("red_mean")), part(F.avg("blue").alias("seg_colorfulness")),
        part(F.count("*").alias("area")), part(F.min("green").alias("red_mean"))))


@query("j07_join_images", f"""{cte('pixels', 'catalogue')}, w as (select filename, avg(red) as red_mean from pixels group by 1),
    c as (select filename, stddev_pop(blue) as img_colorfulness from pixels where filename in (select filename from catalogue where fieldID<25) group by 1),
    o as (select filename, count(distinct segment) as num_orig_segments from pixels group by 1)
    select filename, k.fieldID, img_path, date, {rd('red_mean')} as red_mean, {rd('img_colorfulness')} as img_colorfulness, case when img_colorfulness is not null
      then num_orig_segments end as num_orig_segments from catalogue k join w using (filename) left join c using (filename) left join o using (filename)""")
def j07(spark, sf):
    px, catalogue = pixels(spark, sf), fixture(spark, sf, "catalogue")
    means = px.groupBy("filename").agg(F.avg("red").alias("red_mean"))
    some = px.join(catalogue.where("fieldID < 25").select("filename"), "filename", "left_semi")
    colours = some.groupBy("filename").agg(F.stddev_pop("blue").alias("img_colorfulness"))
    return rounded(wide.join_images(catalogue, means, colours, superpixel.region_counts(px)))


_WIDE = ["red_mean", "nir_median", "NDVI_r_std"]


@query("r17_pivot_segments", f"""{_INDEXED}, f as (select filename, segment, avg(red) as red_mean, median(nir) as nir_median, stddev_pop(NDVI_r) as NDVI_r_std,
      round({_GRAY}, 9) as g from ix group by 1,2),
    k as (select *, row_number() over (partition by filename order by g desc, segment) as i from f)
    select filename, {', '.join(f'{rd(f"max({c}) filter (i={i})")} as {c}_seg_{i}' for c in _WIDE for i in range(1, 5))},
    {', '.join(f'max(segment) filter (i={i}) as segment_seg_{i}' for i in range(1, 5))} from k group by 1""")
def r17p(spark, sf):
    px = pixels(spark, sf)
    gray = px.groupBy(*KEYS).agg(F.round(F.avg(colour.gray()), 9).alias("g"))
    ranked = wide.rank_segments(join_shuffled(features.index_features(px).select(*KEYS, *_WIDE), gray, KEYS), "g").drop("g")
    return rounded(wide.pivot_segments(ranked, 4))


_IMAGE_COLOUR = "sqrt(pow(stddev_pop(rg),2)+pow(stddev_pop(yb),2))+0.3::double*sqrt(pow(avg(rg),2)+pow(avg(yb),2))"
_TABLE_COLUMNS = ["red_mean_x", "nir_median", "seg_colorfulness", "area", "perimeter", "SR"]


@query("r17_image_table", f"""{cte('pixels', 'catalogue')}, {_FEATURE_BODY},
    k as (select *, row_number() over (partition by filename order by gray_mean_intensity desc, segment) as i from f),
    c as (select filename, {_IMAGE_COLOUR} as img_colorfulness from d group by 1)
    select k.filename, fieldID, 4::bigint as num_orig_segments, {rd('max(img_colorfulness)')} as img_colorfulness, {', '.join(
      f'max({c}) filter (i={i}) as {c}_seg_{i}' if c == 'area' else f'{rd(f'max("{c}") filter (i={i})')} as "{c}_seg_{i}"'
      for c in _TABLE_COLUMNS for i in range(1, 5))}
    from k join c using (filename) join catalogue using (filename) group by 1,2""")
def r17(spark, sf):
    px = pixels(spark, sf)
    out = wide.image_table(px, fixture(spark, sf, "catalogue"), superpixel.region_counts(px), ranks=4)
    return rounded(out.select("filename", "fieldID", "num_orig_segments", "img_colorfulness",
                              *[f"{c}_seg_{i}" for c in _TABLE_COLUMNS for i in range(1, 5)]))


@query("f13_wide_names", f"""{cte('catalogue')} select filename, fieldID as fieldID_seg_1 from catalogue""")
def f13(spark, sf):
    # a trailing newline in a file name goes; the feature gets its rank in the name
    df = fixture(spark, sf, "catalogue").select(F.concat("filename", F.lit("\n")).alias("filename"), "fieldID", F.lit(1).alias(wide.RANK))
    return wide.pivot_segments(df, 1)
