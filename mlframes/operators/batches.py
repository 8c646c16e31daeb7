"""Batches of ids and index ranges."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from mlframes.plans.ranks import dense_codes


def id_batches(df: DataFrame, column: str, size: int = 50) -> DataFrame:
    """(id, batch): distinct ids in ascending order, ``size`` to a batch."""
    ids = df.select(F.col(column).alias("id")).where(F.col("id").isNotNull()).distinct()
    return dense_codes(ids, "id", "position").select(
        "id", F.floor(F.col("position") / F.lit(size)).cast("bigint").alias("batch"))


def index_ranges(spark: SparkSession, n_items: int, size: int) -> DataFrame:
    """(start, end) ranges of ``size`` covering ``n_items``; the last may be shorter."""
    batches = spark.range(0, -(-n_items // size))
    start = F.col("id") * size
    return batches.select(start.alias("start"), F.least(start + size, F.lit(n_items)).alias("end"))


def table_ranges(df: DataFrame, size: int) -> DataFrame:
    """(start, end) ranges covering the rows of a table."""
    n = df.agg(F.count("*").alias("n"))
    starts = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size))).alias("start"))
    return starts.select("start", F.least(F.col("start") + size, F.col("n")).alias("end"))
