"""Fixtures over the given tables, and the registration decorator.

A fixture is one SQL text run by both engines; only ``pixels`` has a form per engine, since Spark
derives the pixels of each part row by exploding and SQL by joining with a number range.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES: dict = {}
ORACLES: dict = {}

ROW_KEY = ("concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
           "cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))")

FIXTURES = {
    "scored": """select l_orderkey, l_linenumber, cast(case when l_returnflag='R' then 1 else 0 end as int) as y,
        round(l_discount*10,4) as p, l_quantity/100.0 as p2 from {lineitem}""",
    "classes": """select o_orderkey as id, o_orderstatus as truth,
        case when o_orderkey%5=0 then 'F' when o_orderkey%7<2 then 'O' else o_orderstatus end as pred,
        case when o_orderkey%11=0 then 'X' when o_orderkey%3=0 then 'P' else o_orderstatus end as pred2,
        case when o_orderkey%10<7 then 'Train' when o_orderkey%10<9 then 'Validation' else 'Test' end as split
        from {orders}""",
    "regression": f"""select {ROW_KEY} as k, l_orderkey, l_linenumber,
        case when l_orderkey%10<7 then 'Train' when l_orderkey%10<9 then 'Validation' else 'Test' end as split,
        case when l_orderkey%97=0 then cast(0 as double) else l_extendedprice end as y,
        l_quantity*cast(2000 as double)*(1-l_discount) as yhat, l_extendedprice*l_tax as std, l_returnflag as label,
        l_quantity, l_discount, l_tax from {{lineitem}}""",
    "boosted": f"""select {ROW_KEY} as k, case when l_orderkey%10<7 then 'Train' when l_orderkey%10<9 then 'Validation' else 'Test' end as split,
        case when l_orderkey%13=0 then null else l_quantity end as quantity, case when l_partkey%7=0 then null else l_discount end as discount,
        l_tax as tax, l_quantity*2000*(1-l_discount)+l_extendedprice/50 as y,
        case when l_quantity>34 then 'A' when l_discount>0.06 then 'N' else l_returnflag end as label from {{lineitem}}""",
    "probs": f"""select {ROW_KEY} as k, l_discount+0.01 as w0, l_tax+0.02 as w1, l_quantity/1000.0 as w2 from {{lineitem}}""",
    "ratings": """select c_custkey, case when c_custkey%13=0 then null else round(c_acctbal/1800.0,2) end as rating
        from {customer}""",
    "prep": """select c_custkey as id, case when c_custkey%11=0 then null else c_mktsegment end as segment,
        c_acctbal>0 as positive, cast(c_nationkey as string) as nation_text,
        concat(cast(c_nationkey as string),'-',substr(c_mktsegment,1,1)) as mixed,
        case when c_custkey%17=0 then null else c_acctbal end as acctbal from {customer}""",
    "groups": """select o_orderkey as id, case when o_custkey%50=0 then null else o_custkey end as grp,
        o_totalprice as v from {orders}""",
    "ttest": """select value as feature, event_type='purchase' as cond, user_id, event_type from {events}""",
    "rank_events": """select user_id, event_type, case when ts < timestamp '2024-01-15 00:00:00' then 1 else 2 end as half,
        count(*) as n from {events} group by 1,2,3""",
    "points": """select vec_id as id, label, embedding from {embeddings}""",
    "catalogue": """select concat('img_',cast(p_partkey as string)) as filename, p_size as fieldID,
        concat('/img/',cast(p_partkey as string),'.png') as img_path,
        concat('2024',lpad(cast(1+p_partkey%12 as string),2,'0'),lpad(cast(1+p_partkey%28 as string),2,'0')) as date
        from {part}""",
}

SIDE = 16  # pixels per image side

PIXELS_SQL = f"""select concat('img_',cast(p_partkey as string)) as filename, r.i as "row", c.i as col,
        cast((p_partkey*7+r.i*13+c.i*3)%256 as double) as blue, cast((p_partkey*5+r.i*3+c.i*11)%256 as double) as green,
        cast((p_partkey*3+r.i*r.i+c.i*5)%256 as double) as red, cast((p_partkey*11+r.i*7+c.i*17)%256 as double) as nir,
        cast(1+(case when r.i<6 then 0 else 2 end)+(case when c.i<10 then 0 else 1 end) as int) as segment
        from part, range({SIDE}) r(i), range({SIDE}) c(i)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name == "pixels":
        return pixels(spark, sf)
    text = FIXTURES[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


#: Pixels that a task makes at most, about.
TASK_PIXELS = 1 << 20


def spread(rows: DataFrame, pixels_each: int) -> DataFrame:
    """A parquet file of a few rows becomes many pixels: spread the rows before they grow, over as many tasks as that takes, so
    that what a task sorts or groups of them does not grow with the table."""
    tasks = -(-rows.count() * pixels_each // TASK_PIXELS)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, tasks))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel table: 256 pixels in four rectangular segments for every part."""
    keys = spread(table(spark, sf, "part").select("p_partkey"), SIDE * SIDE)
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = keys.withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    return grid.selectExpr(
        "concat('img_', cast(p_partkey as string)) as filename", "row", "col",
        "cast((p_partkey*7+row*13+col*3)%256 as double) as blue", "cast((p_partkey*5+row*3+col*11)%256 as double) as green",
        "cast((p_partkey*3+row*row+col*5)%256 as double) as red", "cast((p_partkey*11+row*7+col*17)%256 as double) as nir",
        "cast(1+(case when row<6 then 0 else 2 end)+(case when col<10 then 0 else 1 end) as int) as segment")


def cte(*names: str) -> str:
    """``with a as (...), b as (...)`` for the oracle."""
    same = {t: t for t in TABLES}
    parts = [f"{n} as ({PIXELS_SQL if n == 'pixels' else FIXTURES[n].format(**same)})" for n in names]
    return "with " + ", ".join(parts)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, when there is one, the SQL with the same result."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, other: dict[str, int] | None = None) -> DataFrame:
    """Round doubles on the Spark side as ``rd`` does in SQL, and drop the sign of zero. ``other`` names columns with other digits."""
    default, out = digits, []
    for f in df.schema:
        c, digits = F.col(f"`{f.name}`"), (other or {}).get(f.name, default)
        if f.dataType.typeName() == "double":
            r = F.round(c, digits)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "double":
            c = F.transform(c, lambda x: F.when(F.round(x, digits) == 0, F.lit(0.0)).otherwise(F.round(x, digits)))
        out.append(c.alias(f.name))
    return df.select(*out)


def rd(expr: str, digits: int = 6) -> str:
    return f"(case when round({expr}, {digits}) = 0 then 0.0::double else round({expr}, {digits})::double end)"
