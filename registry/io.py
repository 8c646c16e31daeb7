"""Queries that write a table to the shared folder and read it back, and a stream."""

from pyspark.sql import functions as F

from mlframes.operators import encode
from mlframes.plans.storage import shared_path
from mlframes.sources import images, sinks, tables
from mlframes.streaming.score import score_stream
from registry.base import cte, fixture, query, rd, rounded, spread, table


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


_CUSTOMERS = f"select c_custkey, c_mktsegment, {rd('c_acctbal')} as c_acctbal from customer"


@query("s01_read_csv", _CUSTOMERS)
def s01(spark, sf):
    path = shared_path(spark, "csv")
    _customers(spark, sf).write.options(header=True, sep="|").csv(path)
    return rounded(tables.read_table(spark, path, sep="|").withColumn("c_custkey", F.col("c_custkey").cast("bigint")))


@query("s02_read_json", _CUSTOMERS)
def s02(spark, sf):
    path = shared_path(spark, "json") + ".json"
    rows = _customers(spark, sf)
    # one JSON array per file, as a table dumped by another tool comes
    rows.groupBy(F.pmod("c_custkey", F.lit(8)).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.partitionBy("part").text(path)
    return rounded(tables.read_table(spark, path).drop("part"))


@query("s02_read_json_lines", _CUSTOMERS)
def s02_lines(spark, sf):
    path = shared_path(spark, "json") + ".json"
    _customers(spark, sf).write.json(path)
    return rounded(tables.read_table(spark, path))


@query("s03_read_csv_folder", f"""select c_custkey, {rd('case when c_custkey%2=0 then c_acctbal end')} as c_acctbal,
    case when c_custkey%2=1 then c_mktsegment end as c_mktsegment from customer""")
def s03(spark, sf):
    path, df = shared_path(spark, "folder"), _customers(spark, sf)
    df.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal").write.option("header", True).csv(f"{path}/even")
    df.where("c_custkey % 2 = 1").select("c_mktsegment", "c_custkey").write.option("header", True).csv(f"{path}/odd")
    out = tables.read_csv_folder(spark, f"{path}/*/*.csv")
    return rounded(out.withColumn("c_custkey", F.col("c_custkey").cast("bigint")))


@query("s02_read_json_mixed", _CUSTOMERS)
def s02_mixed(spark, sf):
    # files of JSON lines and of one array each, in one folder
    path, rows = shared_path(spark, "json") + ".json", _customers(spark, sf)
    rows.where("c_custkey % 3 = 0").write.json(path)
    rows.where("c_custkey % 3 <> 0").groupBy(F.pmod("c_custkey", F.lit(4)).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).drop("part").write.mode("append").text(path)
    return rounded(tables.read_table(spark, path))


@query("s03_read_csv_folder_types", f"""select c_custkey, {rd("case when c_custkey%3=0 then c_custkey else c_acctbal end")} as amount,
    case when c_custkey%2=0 then c_custkey::varchar else c_mktsegment end as mixed from customer""")
def s03_types(spark, sf):
    # whole numbers in some files and fractions in others, numbers here and words there
    path, df = shared_path(spark, "folder"), _customers(spark, sf)
    for i in range(6):
        amount = F.col("c_custkey").cast("string") if i % 3 == 0 else F.col("c_acctbal").cast("string")
        mixed = F.col("c_custkey").cast("string") if i % 2 == 0 else F.col("c_mktsegment")
        part = df.where(F.col("c_custkey") % 6 == i).select("c_custkey", amount.alias("amount"), mixed.alias("mixed"))
        part.select(*(part.columns if i < 3 else part.columns[::-1])).write.option("header", True).csv(f"{path}/{i}")
    return rounded(tables.read_csv_folder(spark, f"{path}/*/*.csv").select("c_custkey", "amount", "mixed"))


@query("s04_read_objects", "select c_custkey, c_mktsegment from customer")
def s04(spark, sf):
    path, df = shared_path(spark, "objects"), _customers(spark, sf).select("c_custkey", "c_mktsegment")
    for i, name in enumerate(("first.csv", "second.csv")):
        df.where(F.col("c_custkey") % 2 == i).write.option("header", True).csv(f"{path}/{name}")
    found, missing = tables.read_objects(spark, path, ["first.csv", "absent.csv", "second.csv"])
    if missing != ["absent.csv"]:
        raise AssertionError(missing)
    return found.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("s05_read_query", "select c_mktsegment, count(*) as n from customer group by 1")
def s05(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("mlframes_customers")
    return tables.read_query(spark, "select c_mktsegment, count(*) as n from mlframes_customers group by 1")


@query("s06_load_with_target", f"select c_custkey, {rd('c_acctbal')} as c_acctbal from customer")
def s06(spark, sf):
    df, features = tables.with_target(tables.load(spark, _customers(spark, sf)), "c_acctbal")
    return rounded(df.select(features[0], "c_acctbal"))


@query("s07_write_csv", "select c_mktsegment, count(*) as n from customer group by 1")
def s07(spark, sf):
    path = shared_path(spark, "result")
    sinks.write_table(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), path)
    return spark.read.schema("c_mktsegment string, n bigint").option("header", True).csv(path)


@query("s08_publish", "select c_mktsegment, count(*) as n from customer group by 1")
def s08(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    folder = sinks.publish({"results": counts, "data": _customers(spark, sf)}, shared_path(spark, "publish"))
    return spark.read.parquet(f"{folder}/results")


@query("s10_save_and_load", f"""{cte('prep')}, c as (select id, coalesce(acctbal,-1) as a, (dense_rank() over (order by mixed)-1)::bigint as m from prep)
    select id, {rd('(a-avg(a) over ())/stddev_pop(a) over ()')} as acctbal, {rd('(m-avg(m) over ())/stddev_pop(m) over ()')} as mixed from c""")
def s10(spark, sf):
    df, path = fixture(spark, sf, "prep"), shared_path(spark, "prep")
    encode.Prep.fit(df, id_col="id", features=["acctbal", "mixed"], threshold=10).save(spark, path)
    return rounded(encode.Prep.load(spark, path).transform(df))


@query("s09_raw_images", f"""select concat('img_', p_partkey::varchar) as filename, count(*) as n, {rd('avg((p_partkey*7+r.i*13+c.i*3)%256)')} as blue,
    {rd('avg((p_partkey*11+r.i*7+c.i*17)%256)')} as nir, {rd('sum(r.i*((p_partkey*7+r.i*13+c.i*3)%256))')} as row_blue
    from part, range(4) r(i), range(4) c(i) group by 1""")
def s09(spark, sf):
    """Raw four-band images of 4 x 4 pixels, one per part, written by Spark and read back as pixels."""
    k, side = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(3))

    def pixel(r, c):
        bands = [(k * 7 + r * 13 + c * 3) % 256, k % 256, (k + r) % 256, (k * 11 + r * 7 + c * 17) % 256]
        return F.concat(*[F.lpad(F.hex(b), 2, "0") for b in bands])

    h = F.array_join(F.flatten(F.transform(side, lambda r: F.transform(side, lambda c: pixel(r, c)))), "")
    stored = spread(table(spark, sf, "part").select("p_partkey"), 16).select(F.concat(F.lit("img_"), k.cast("string")).alias("filename"),
                                                                             F.unhex(h).alias("content"))
    px = images.raw_pixels(stored, 4, 4, dtype="u1")
    return rounded(px.groupBy("filename").agg(F.count("*").alias("n"), F.avg("blue").alias("blue"), F.avg("nir").alias("nir"),
                                              F.sum(F.col("row") * F.col("blue")).alias("row_blue")))


@query("streamed_preparation", f"""{cte('prep')} select id, {rd('(coalesce(acctbal,-1)-avg(coalesce(acctbal,-1)) over ())/stddev_pop(coalesce(acctbal,-1)) over ()')} as acctbal from prep""")
def streamed(spark, sf):
    df = fixture(spark, sf, "prep").select("id", "acctbal")
    model, arriving, out = encode.Prep.fit(df, id_col="id"), shared_path(spark, "arriving"), shared_path(spark, "scored")
    df.write.parquet(arriving)
    score_stream(spark.readStream.schema(df.schema).parquet(arriving), [model.transform], out).awaitTermination()
    return rounded(spark.read.parquet(out))
