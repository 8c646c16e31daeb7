"""Queries over splits, encoding, tests, fits and table handling."""

from pyspark.sql import functions as F

from mlframes.functions import bins, nulls
from mlframes.operators import batches, columns, encode, split, stats
from mlframes.plans.ranks import first_per_key
from registry.base import cte, fixture, query, rd, rounded, table


def _hash(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 13))::bigint"


@query("a01_ttest", f"""{cte('ttest')}, m as (select event_type, count(feature) filter (cond2) as n1, count(feature) filter (not cond2) as n2,
      avg(feature) filter (cond2) as mean1, avg(feature) filter (not cond2) as mean2,
      var_samp(feature) filter (cond2) as v1, var_samp(feature) filter (not cond2) as v2
      from (select *, user_id % 2 = 0 as cond2 from ttest) group by 1)
    select event_type, n1, n2, {rd('mean1')} as mean1, {rd('mean2')} as mean2,
      {rd('(mean1-mean2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0::double/n1+1.0::double/n2))')} as t, n1+n2-2 as df from m""")
def a01(spark, sf):
    df = fixture(spark, sf, "ttest").withColumn("even", F.col("user_id") % 2 == 0)
    return rounded(stats.ttest(df, "feature", "even", ["event_type"], p_value=False))


@query("a01_ttest_p", f"""{cte('ttest')}, m as (select event_type, count(*) filter (e) as n1, count(*) filter (not e) as n2, avg(feature) filter (e) as m1,
      avg(feature) filter (not e) as m2, var_samp(feature) filter (e) as v1, var_samp(feature) filter (not e) as v2
      from (select *, user_id % 2 = 0 as e from ttest) group by 1),
    t as (select event_type, n1+n2-2 as df, abs(m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0::double/n1+1.0::double/n2)) as t from m)
    select event_type, t > 1.959964 + 2.3722712/df as significant_5, t > 2.5758293 + 4.9165/df as significant_1 from t""")
def a01p(spark, sf):
    # critical values of t by their expansion around the normal quantile
    df = fixture(spark, sf, "ttest").withColumn("even", F.col("user_id") % 2 == 0)
    return stats.ttest(df, "feature", "even", ["event_type"]).select(
        "event_type", (F.col("p") < 0.05).alias("significant_5"), (F.col("p") < 0.01).alias("significant_1"))


@query("p09_conditional_sides", f"""{cte('ttest')} select count(*) filter (cond) as n1, count(*) filter (not cond) as n2,
    {rd('avg(feature) filter (cond)')} as mean1, {rd('avg(feature) filter (not cond)')} as mean2 from ttest""")
def p09(spark, sf):
    return rounded(stats.ttest(fixture(spark, sf, "ttest"), "feature", "cond", p_value=False)
                   .select("n1", "n2", "mean1", "mean2"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a15_correlations", " union all ".join(
    f"select '{a}' as feature_x, '{b}' as feature_y, {rd(f'corr({a},{b})', 2)} as corr from lineitem"
    for i, a in enumerate(_NUM) for b in _NUM[i:]))
def a15(spark, sf):
    return rounded(stats.correlations(table(spark, sf, "lineitem"), _NUM), 2)


@query("a19_fit_line", f"""{cte('regression')} select label, {rd('regr_intercept(yhat,y)')} as intercept, {rd('regr_slope(yhat,y)', 9)} as slope
    from regression group by 1""")
def a19(spark, sf):
    fit = stats.fit_line(fixture(spark, sf, "regression"), "y", "yhat", ["label"])
    return fit.select("label", F.round("intercept", 6).alias("intercept"), F.round("slope", 9).alias("slope"))


@query("a19_fit_band", f"""{cte('regression')}, f as (select regr_intercept(yhat,y) as a, regr_slope(yhat,y) as b, min(y) as lo, max(y) as hi from regression)
    select {rd('lo+(hi-lo)*i/19', 4)} as x, {rd('a+b*(lo+(hi-lo)*i/19)', 4)} as fit, true as inside from f, range(20) t(i)""")
def a19_band(spark, sf):
    band = stats.fit_band(fixture(spark, sf, "regression"), "y", "yhat", "k", points=20)
    return rounded(band.select("x", "fit", ((F.col("low") <= F.col("fit")) & (F.col("fit") <= F.col("high"))).alias("inside")), 4)


# the same line through values near a thousand million
@query("a19_fit_band_far", f"""{cte('regression')}, f as (select regr_intercept(yhat,y) as a, regr_slope(yhat,y) as b, min(y) as lo, max(y) as hi from regression)
    select {rd('lo+(hi-lo)*i/9', 2)} as offset, {rd('a+b*(lo+(hi-lo)*i/9)', 2)} as fit, true as inside from f, range(10) t(i)""")
def a19_band_far(spark, sf):
    far = fixture(spark, sf, "regression").withColumn("y", F.col("y") + 1e9)
    band = stats.fit_band(far, "y", "yhat", "k", points=10, replicates=200)
    return rounded(band.select((F.col("x") - 1e9).alias("offset"), "fit", ((F.col("low") <= F.col("fit")) & (F.col("fit") <= F.col("high"))).alias("inside")), 2)


@query("a20_trend_line", f"""with d as (select o_orderdate::date as day, sum(o_totalprice) as total from orders group by 1),
    n as (select *, row_number() over (order by day) - 1 as position from d),
    f as (select regr_intercept(total, position) as a, regr_slope(total, position) as b from n)
    select day, position, {rd('total', 4)} as total, {rd('a+b*position', 4)} as trend from n, f""")
def a20(spark, sf):
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return rounded(stats.trend_line(days, "day", "total"), 4)


@query("a21_distinct_counts", f"""{cte('prep')} select 'segment' as "column", count(distinct segment) as n from prep
    union all select 'nation_text', count(distinct nation_text) from prep union all select 'mixed', count(distinct mixed) from prep
    union all select 'positive', count(distinct positive) from prep""")
def a21(spark, sf):
    return encode.distinct_counts(fixture(spark, sf, "prep"))


@query("a22_scale_stats", " union all ".join(
    f"select '{c}' as feature, {rd(f'avg({c})')} as mean, {rd(f'stddev_pop({c})')} as std from lineitem" for c in _NUM))
def a22(spark, sf):
    return rounded(encode.scale_stats(table(spark, sf, "lineitem"), _NUM))


@query("f01_rating_bins", f"""{cte('ratings')} select c_custkey, case when rating>=0 and rating<=3.99 then '(-0.001, 3.99]'
    when rating>3.99 and rating<=4.99 then '(3.99, 4.99]' when rating>4.99 and rating<=5 then '(4.99, 5.0]' else 'Missing' end as bin
    from ratings""")
def f01(spark, sf):
    return fixture(spark, sf, "ratings").select("c_custkey", bins.rating_bin("rating").alias("bin"))


@query("f08_replace_inf", """select l_returnflag, count(*) as n, count(*) filter (l_tax<>0) as n_finite,
    round(sum(case when l_tax<>0 then l_discount/l_tax end),6) as total from lineitem group by 1""")
def f08(spark, sf):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_discount", "l_tax"))
    df = table(spark, sf, "lineitem").select("l_returnflag", nulls.replace_inf(ratio).alias("v"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("n_finite"),
                                          F.round(F.sum("v"), 6).alias("total"))


@query("w01_dense_codes", f"""{cte('prep')} select id, mixed, (dense_rank() over (order by mixed)-1)::bigint as code from prep""")
def w01(spark, sf):
    df = fixture(spark, sf, "prep").select("id", "mixed")
    coded = encode.label_encode(df).withColumnRenamed("mixed", "code")
    return coded.join(df, "id").select("id", "mixed", "code")


@query("m01_to_numeric", f"""{cte('prep')} select id, segment, positive, nation_text::double as nation_text, mixed, {rd('acctbal')} as acctbal from prep""")
def m01(spark, sf):
    return rounded(encode.to_numeric(fixture(spark, sf, "prep")))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("m02_onehot", f"""{cte('prep')} select id, nation_text, mixed, {rd('acctbal')} as acctbal, {', '.join(
    f"coalesce(segment='{s}',false)::int as segment_{s}" for s in _SEGMENTS)}, positive::int as "positive_True" from prep""")
def m02(spark, sf):
    return rounded(encode.onehot_encode(fixture(spark, sf, "prep"), threshold=10))


@query("m02_onehot_null_as_text", f"""{cte('prep')} select id, nation_text, mixed, {rd('acctbal')} as acctbal, {', '.join(
    f"coalesce(segment='{s}',false)::int as segment_{s}" for s in _SEGMENTS)}, (segment is null)::int as segment_nan,
    positive::int as "positive_True", (not positive)::int as "positive_False" from prep""")
def m02n(spark, sf):
    return rounded(encode.onehot_encode(fixture(spark, sf, "prep"), threshold=10, null_as="nan", drop_false=False))


_CODED = """select id, {bal} as acctbal, (dense_rank() over (order by coalesce(segment,'nan'))-1)::bigint as segment,
    (dense_rank() over (order by nation_text)-1)::bigint as nation_text, (dense_rank() over (order by mixed)-1)::bigint as mixed,
    (dense_rank() over (order by positive::int)-1)::bigint as positive from prep"""


@query("m03_label_codes", f"{cte('prep')} {_CODED.format(bal=rd('acctbal'))}")
def m03(spark, sf):
    return rounded(encode.label_encode(fixture(spark, sf, "prep")))


@query("m04_standardise", f"""{cte('prep')}, s as (select avg(acctbal) as m, stddev_pop(acctbal) as d from prep)
    select id, {rd('(acctbal-m)/d')} as acctbal from prep, s""")
def m04(spark, sf):
    df = fixture(spark, sf, "prep").select("id", "acctbal")
    return rounded(encode.scale(df, encode.collect_stats(df, ["acctbal"])))


@query("m05_fill", f"""{cte('prep')} select id, {rd('coalesce(acctbal,-1)')} as acctbal from prep""")
def m05(spark, sf):
    return rounded(fixture(spark, sf, "prep").select("id", "acctbal").fillna(encode.DEFAULT_FILL))


@query("m06_prepare", f"""{cte('prep')}, coded as (select id, nation_text::double as nation_text, coalesce(acctbal,-1) as acctbal,
      {', '.join(f"coalesce(segment='{s}',false)::int as segment_{s}" for s in _SEGMENTS)}, positive::int as "positive_True",
      (dense_rank() over (order by mixed)-1)::bigint as mixed from prep)
    select id, {', '.join(rd(f'("{c}"-avg("{c}") over ())/(case when stddev_pop("{c}") over ()=0 then 1 else stddev_pop("{c}") over () end)')
                          + f' as "{c}"' for c in ['nation_text', 'acctbal', *[f'segment_{s}' for s in _SEGMENTS], 'positive_True', 'mixed'])}
    from coded""")
def m06(spark, sf):
    df = fixture(spark, sf, "prep")
    return rounded(encode.Prep.fit(df, id_col="id", threshold=10).transform(df))


@query("m07_split_hash", f"""{cte('groups')} select id, case when {_hash("id::varchar")}/4503599627370496.0::double<0.25 then 'Validation'
    when {_hash("id::varchar")}/4503599627370496.0::double<0.35 then 'Test' else 'Train' end as split from groups""")
def m07(spark, sf):
    return split.add_split(fixture(spark, sf, "groups"), "id").select("id", "split")


_EXACT = """, r as (select {k} as g, row_number() over (order by md5('42:' || {k})) as i, count(*) over () as n from {source}),
    c as (select *, ceil(0.25*n) as nv, ceil((0.1::double/(1-0.25::double))*(n-ceil(0.25*n))) as nt from r)"""


@query("m07_split_exact", f"""{cte('groups')} {_EXACT.format(k='id::varchar', source='groups')}
    select g::bigint as id, case when i<=nv then 'Validation' when i<=nv+nt then 'Test' else 'Train' end as split from c""")
def m07e(spark, sf):
    return split.add_split(fixture(spark, sf, "groups"), "id", mode="exact").select("id", "split")


_GROUP_LABELS = f"""{cte('groups')}, gs as (select distinct coalesce(grp::varchar, '\\N') as gk from groups)
    {_EXACT.format(k='gk', source='gs')}, lab as (select g, case when i<=nv then 'Validation' when i<=nv+nt then 'Test' else 'Train' end as split from c)"""


@query("m07_split_by_group", f"{_GROUP_LABELS} select id, split from groups join lab on g=coalesce(grp::varchar, '\\N')")
def m07g(spark, sf):
    return split.add_split(fixture(spark, sf, "groups"), "id", "grp", mode="exact").select("id", "split")


@query("j01_attach_group_labels", f"{_GROUP_LABELS} select id, {rd('v')} as v, split from groups join lab on g=coalesce(grp::varchar, '\\N')")
def j01(spark, sf):
    df = fixture(spark, sf, "groups")
    labels = split.add_split(df.select("grp").distinct(), "grp", mode="exact")
    return rounded(split.attach_group_labels(df, labels, ["grp"]).select("id", "v", "split"))


@query("p01_select_features", f"select l_orderkey, {rd('l_quantity')} as l_quantity, {rd('l_tax')} as l_tax from lineitem")
def p01(spark, sf):
    return rounded(columns.select_features(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_orderkey"))


@query("p02_drop_columns", "select c_custkey, c_name, c_nationkey from customer")
def p02(spark, sf):
    return columns.drop_columns(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment", "absent"])


@query("p03_first_of_each_name", "select c_custkey, c_mktsegment from customer")
def p03(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("c_mktsegment"))
    return columns.first_of_each_name(df)


@query("p04_safe_names", 'select c_custkey as "c_0_", c_nationkey as "c_nation" from customer')
def p04(spark, sf):
    return columns.safe_names(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("c[0]"), F.col("c_nationkey").alias("c<nation")))


@query("p05_split_rows", f"{cte('regression')} select k, {rd('y')} as y from regression where split='Train'")
def p05(spark, sf):
    return rounded(columns.split_rows(fixture(spark, sf, "regression"), "Train").select("k", "y"))


@query("p06_member_rows", f"{cte('catalogue')} select * from catalogue where fieldID in (7, 21, 42)")
def p06(spark, sf):
    return columns.member_rows(fixture(spark, sf, "catalogue"), [7, 21, 42])


@query("p06_member_rows_by_table", f"""{cte('catalogue')} select * from catalogue where fieldID in (select n_nationkey from nation)""")
def p06t(spark, sf):
    return columns.member_rows(fixture(spark, sf, "catalogue"), table(spark, sf, "nation").select("n_nationkey"))


@query("p08_scatter_points", f"""{cte('regression')} select label, {rd('y')} as y, {rd('yhat')} as yhat from regression
    where y between 0 and 10000 and yhat between 0 and 10000""")
def p08(spark, sf):
    return rounded(columns.scatter_points(fixture(spark, sf, "regression"), "y", "yhat", "label"))


@query("o04_sorted_groups", f"{cte('regression')} select distinct label from regression order by label")
def o04(spark, sf):
    return columns.sorted_groups(fixture(spark, sf, "regression"), "label")


@query("u01_stack", f"""{cte('regression')} select k, {rd('y')} as y, null::double as yhat from regression where split='Train'
    union all select k, null, {rd('yhat')} from regression where split='Test'""")
def u01(spark, sf):
    df = fixture(spark, sf, "regression")
    return rounded(columns.stack(df.where("split='Train'").select("k", "y"), df.where("split='Test'").select("k", "yhat")))


@query("u02_distinct_keys", f"{cte('groups')} select distinct grp from groups")
def u02(spark, sf):
    return columns.distinct_keys(fixture(spark, sf, "groups"), "grp")


@query("w02_first_per_id", """select o_custkey, o_orderkey, o_orderstatus, o_orderpriority from (select *, row_number() over
    (partition by o_custkey order by o_orderdate, o_orderkey) as i from orders) where i=1""")
def w02(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return first_per_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("f10_id_batches", """select distinct l_orderkey as id, ((dense_rank() over (order by l_orderkey)-1)//50)::bigint as batch from lineitem""")
def f10(spark, sf):
    return batches.id_batches(table(spark, sf, "lineitem"), "l_orderkey")


@query("f11_index_ranges", """with n as (select count(*) as n from orders), s as (select unnest(range(0, n, 64)) as start, n from n)
    select start, least(start+64, n) as "end" from s""")
def f11(spark, sf):
    return batches.table_ranges(table(spark, sf, "orders"), 64)


@query("m14_actual_versus_predicted", f"""{cte('regression')}, f as (select regr_intercept(yhat,y) as a, regr_slope(yhat,y) as b from regression)
    select {rd('y')} as actual, {rd('yhat')} as predicted, case when l_discount>=l_tax then 'l_discount' else 'l_tax' end as label,
    {rd('a+b*y')} as fitted from regression, f where y between 0 and 12000 and yhat between 0 and 12000""")
def m14(spark, sf):
    return rounded(stats.actual_versus_predicted(fixture(spark, sf, "regression"), "y", "yhat", ["l_discount", "l_tax"]))
