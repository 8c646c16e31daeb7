"""Tables from files, object lists, queries and in-memory data."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mlframes.operators.columns import stack
from mlframes.operators.encode import NUMBER


def read_table(spark: SparkSession, path: str, sep: str | None = None, schema=None) -> DataFrame:
    """A CSV or JSON table by its suffix; ``sep`` reads any file as delimited text.

    Without a schema the types are inferred, which reads the file once more. A JSON file whose first line holds a whole
    object or array has one value per line; any other is one document. Each file of a folder is read in its own form.
    """
    if sep is None and path.endswith(".json"):
        first = _first_lines(spark, path).select("path", F.trim("first").alias("v"))
        lines = F.col("v").rlike(r"(?s)^(\{.*\}|\[.*\])$")
        forms = {r["lines"]: r["paths"] for r in first.groupBy(lines.alias("lines")).agg(F.collect_list("path").alias("paths")).collect()}
        read = [(reader.schema(schema) if schema else reader).json(sorted(paths)) for form, paths in sorted(forms.items())
                for reader in [spark.read.options(multiLine=not form, mode="FAILFAST")]]
        return stack(*read) if read else spark.read.schema(schema or "value string").json(path)
    if sep is None and not path.endswith(".csv"):
        raise ValueError(f"not a .csv or .json path: {path}; pass sep for other delimited text")
    return _csv(spark, path, sep or ",", schema)


def _csv(spark, path, sep=",", schema=None):
    reader = spark.read.options(header=True, sep=sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def _first_lines(spark: SparkSession, paths) -> DataFrame:
    """(path, first): the first line of each file that is not blank."""
    lines = spark.read.text(paths).select(
        "value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"))
    return lines.where("start = 0 and trim(value) <> ''").groupBy("path").agg(F.min_by("value", "line").alias("first"))


#: What a column of text may be read as, narrowest first, and the form its values must have; anything else stays text.
TYPES = {"bigint": r"^\s*[+-]?\d+\s*$", "double": NUMBER, "boolean": r"^(?i:true|false)$", "date": r"^\d{4}-\d{2}-\d{2}$",
         "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"}


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as the first of ``TYPES`` that every value of the whole table fits, found by one aggregate. Whole numbers
    beside fractions become doubles, and numbers beside words stay text."""
    if not df.columns:
        return df
    fits = []
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`")
        fits += [F.coalesce(F.bool_and(text.isNull() | text.rlike(form) & F.trim(text).try_cast(t).isNotNull()), F.lit(True)).alias(f"{i}_{t}")
                 for t, form in TYPES.items()]
        fits.append(F.count(text).alias(f"n{i}"))
    row = df.agg(*fits).first()
    kinds = [next((t for t in TYPES if row[f"n{i}"] and row[f"{i}_{t}"]), "string") for i in range(len(df.columns))]
    return df.select(*[(F.trim(F.col(f"`{c}`")) if t != "string" else F.col(f"`{c}`")).cast(t).alias(c) for c, t in zip(df.columns, kinds)])


def _csv_files(spark: SparkSession, paths, sep: str) -> DataFrame | None:
    """Files with any headers as one table, columns matched by name and typed over all files; None without a row."""
    first = _first_lines(spark, paths)
    groups = first.groupBy("first").agg(F.collect_list("path").alias("paths")).collect()  # one row per distinct header
    read = [spark.read.options(header=True, sep=sep, inferSchema=False).csv(sorted(g["paths"])) for g in sorted(groups, key=lambda g: g["first"])]
    return _typed(stack(*read)) if read else None


def read_csv_folder(spark: SparkSession, pattern: str, sep: str = ",") -> DataFrame:
    """Every CSV under a pattern as one table, columns matched by name.

    A single read would match columns by position, so files are grouped by their header line: one distributed pass finds the
    headers, one read per distinct header gives text, and one aggregate over all of it decides the types.
    """
    try:
        table = _csv_files(spark, pattern, sep)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no files match {pattern}") from e
        raise
    if table is None:
        raise FileNotFoundError(f"no rows under {pattern}")
    return table


def existing_paths(spark: SparkSession, paths) -> tuple[list[str], list[str]]:
    """(present, absent) paths, on any file system Spark can reach."""
    hadoop, present, absent = spark.sparkContext._jsc.hadoopConfiguration(), [], []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        (present if path.getFileSystem(hadoop).exists(path) else absent).append(p)
    return present, absent


def read_objects(spark: SparkSession, folder: str, names, sep: str = ",") -> tuple[DataFrame | None, list[str]]:
    """(one table of the named objects that exist, the names that do not), read in place."""
    paths = {f"{folder.rstrip('/')}/{n}": n for n in names}
    present, absent = existing_paths(spark, paths)
    table = _csv_files(spark, present, sep) if present else None
    return table, [paths[p] for p in absent]


def read_query(spark: SparkSession, query: str, source: str | None = None, **options) -> DataFrame:
    """Result of a SQL query: on registered views and tables, or pushed to ``source``, a data source such as a
    warehouse connector that takes a ``query`` option."""
    if source is None:
        return spark.sql(query)
    return spark.read.format(source).options(**options).option("query", query).load()


def load(spark: SparkSession, data, columns=None) -> DataFrame:
    """A DataFrame as it is; a pandas frame or a 2-D array as a DataFrame (columns 0..n-1 unless named)."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, np.ndarray):
        data = pd.DataFrame(data, columns=columns)
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data.rename(columns=str))
    raise TypeError("data must be a Spark or pandas DataFrame or a numpy array")


def with_target(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """The table and its feature names; the target must be a column and stays in the table."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column")
    return df, [c for c in df.columns if c != target]
