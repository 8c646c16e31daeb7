"""Column selection and naming."""

import re

from pyspark.sql import DataFrame, functions as F

# Characters a feature name may not hold, and their replacement.
FORBIDDEN_IN_NAMES = r"\[|\]|<"
REPLACEMENT = "_"


def select_features(df: DataFrame, features=None, id_col: str | None = None) -> DataFrame:
    """The id and the features; all other columns when no features are named."""
    features = [c for c in (features or df.columns) if c != id_col]
    return df.select(*([id_col] if id_col else []), *features)


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*columns)


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with one name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"c{names.index(n)}").alias(n) for n in dict.fromkeys(names)])


def safe_names(df: DataFrame) -> DataFrame:
    """Replace brackets and less-than signs in column names."""
    return df.toDF(*[re.sub(FORBIDDEN_IN_NAMES, REPLACEMENT, c) for c in df.columns])


def split_rows(df: DataFrame, part: str, split: str = "split") -> DataFrame:
    """Rows of one part, without the split column."""
    return df.where(F.col(split) == part).drop(split)


def member_rows(df: DataFrame, field_ids, files=(), field: str = "fieldID", file: str = "filename") -> DataFrame:
    """Rows of the given fields and, when named, files. A list is a literal filter and reaches the scan;
    a DataFrame of ids is a semi join."""
    for column, wanted in ((field, field_ids), (file, files)):
        if isinstance(wanted, DataFrame):
            df = df.join(wanted.select(F.col(wanted.columns[0]).alias(column)), column, "left_semi")
        else:
            wanted = [wanted] if isinstance(wanted, (int, str)) else list(wanted)
            if wanted or column == field:
                df = df.where(F.col(column).isin(wanted))
    return df


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, absent ones NULL."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def distinct_keys(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys).distinct()


def sorted_groups(df: DataFrame, by: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(by).distinct().orderBy(by)


def scatter_points(df: DataFrame, x: str, y: str, by: str, low: float = 0, high: float = 10_000) -> DataFrame:
    """(group, x, y) of the points inside the axis range."""
    return df.select(by, x, y).where(F.col(x).between(low, high) & F.col(y).between(low, high))
