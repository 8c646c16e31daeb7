"""Fit and apply table preparation: numeric text, one-hot, label codes, fill, scale."""

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, LongType, DoubleType

from mlframes.plans.joins import BROADCAST_ROWS, attach, join_on
from mlframes.plans.ranks import dense_codes
from mlframes.plans.storage import checkpoint

# What counts as a number in text, and names used by the encoders.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NULL_TEXT = "nan"
SPLIT = "split"
DEFAULT_FILL = -1.0
DEFAULT_THRESHOLD = 100

_CODES = StructType([StructField("column", StringType()), StructField("value", StringType()),
                     StructField("code", LongType())])
_STATS = StructType([StructField("feature", StringType()), StructField("mean", DoubleType()),
                     StructField("std", DoubleType())])


def numeric_text_columns(df: DataFrame, columns=None) -> list[str]:
    """Text columns whose every value is a number; one aggregation over all of them."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not columns:
        return []
    bad = [F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(NUMBER)).alias(f"bad{i}") for i, c in enumerate(columns)]
    filled = [F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]
    row = df.agg(*bad, *filled).first()
    return [c for i, c in enumerate(columns) if row[f"bad{i}"] == 0 and row[f"n{i}"] > 0]


def to_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Turn each fully numeric text column into doubles; leave the others."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in numeric_text_columns(df, columns)})


def categorical_columns(df: DataFrame, skip=(SPLIT,)) -> list[str]:
    """Text columns, then boolean columns."""
    kinds = [[f.name for f in df.schema if isinstance(f.dataType, kind) and f.name not in skip]
             for kind in (StringType, BooleanType)]
    return kinds[0] + kinds[1]


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, n): distinct non-null values of the categorical columns."""
    columns = columns or categorical_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).distinct()
    return values.groupBy("column").agg(F.count("value").alias("n"))


def as_text(df: DataFrame, c: str) -> Column:
    """Text form of a category; booleans read True and False."""
    column = F.col(c)
    if isinstance(df.schema[c].dataType, BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    return column


def indicator(value: Column, category: str) -> Column:
    return value.eqNullSafe(F.lit(category)).cast("int")


class Encoder:
    """Stored categories and codes of a table's text and boolean columns."""

    def __init__(self, onehot: dict[str, list[str]], codes: DataFrame | None, code_counts: dict[str, int],
                 null_as: str | None, booleans: list[str], drop_false: bool, unseen="error"):
        self.onehot, self.codes, self.code_counts = onehot, codes, code_counts
        self.null_as, self.booleans, self.drop_false, self.unseen = null_as, booleans, drop_false, unseen

    @classmethod
    def fit(cls, df: DataFrame, threshold: int = DEFAULT_THRESHOLD, null_as: str | None = None,
            drop_false: bool = True, skip=(SPLIT,), unseen="error") -> "Encoder":
        """One pass finds the distinct (column, value) pairs; all else works on those.

        Columns with at most ``threshold`` values become indicators, the others sorted integer codes.
        ``null_as`` names a category for NULL; otherwise NULL has no indicator. ``unseen`` is 'error'
        or the code given to a value not met at fit.
        """
        columns = categorical_columns(df, skip)
        booleans = [f.name for f in df.schema if isinstance(f.dataType, BooleanType)]
        if not columns:
            return cls({}, None, {}, null_as, [], drop_false, unseen)
        text = {c: as_text(df, c) for c in columns}
        if null_as is not None:
            text = {c: F.coalesce(t, F.lit(null_as)) for c, t in text.items()}
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in text.items()])
        values = checkpoint(df.select(F.inline(pairs)).distinct())
        sizes = {r["column"]: r["n"] for r in
                 values.groupBy("column").agg(F.count("value").alias("n")).collect()}
        small = [c for c in columns if sizes.get(c, 0) <= threshold]
        large = [c for c in columns if c not in small]
        onehot = {c: [] for c in small}
        if small:  # at most `threshold` values per column
            for r in values.where(F.col("column").isin(small) & F.col("value").isNotNull()).collect():
                onehot[r["column"]].append(r["value"])
        onehot = {c: sorted(v) for c, v in onehot.items()}
        codes, counts = None, {}
        for c in large:
            own = (values.where(F.col("column") == c)
                   .select(F.coalesce("value", F.lit(NULL_TEXT)).alias("value")).distinct())
            coded = dense_codes(own, "value").select(F.lit(c).alias("column"), "value", "code")
            codes = coded if codes is None else codes.unionByName(coded)
        if codes is not None:
            codes = checkpoint(codes)
            found = {r["column"]: r["n"] for r in
                     codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
            counts = {c: found[c] for c in large}  # columns keep the order of the table
        return cls(onehot, codes, counts, null_as, booleans, drop_false, unseen)

    def indicator_names(self, c: str) -> dict[str, str]:
        """Category to column name; the False side of a boolean is dropped on request."""
        hidden = {"False"} if self.drop_false and c in self.booleans else set()
        return {v: f"{c}_{v}" for v in self.onehot[c] if v not in hidden}

    def transform(self, df: DataFrame) -> DataFrame:
        """Uncoded columns, then indicators, then codes. Row-wise but for the code lookups."""
        coded = [*self.onehot, *self.code_counts]
        plain = [F.col(f"`{c}`") for c in df.columns if c not in coded]
        marks = []
        for c in self.onehot:
            text = as_text(df, c)
            text = F.coalesce(text, F.lit(self.null_as)) if self.null_as is not None else text
            marks += [indicator(text, v).alias(name) for v, name in self.indicator_names(c).items()]
        texts = [F.coalesce(as_text(df, c), F.lit(NULL_TEXT)).alias(f"__{c}") for c in self.code_counts]
        out = df.select(*plain, *marks, *texts)
        kept = out.columns[:len(plain) + len(marks)]
        for c, n in self.code_counts.items():
            lookup = self.codes.where(F.col("column") == c).select(F.col("value").alias(f"__{c}"),
                                                                   F.col("code").alias(f"__code_{c}"))
            out = (join_on(out, F.broadcast(lookup), [f"__{c}"], "left") if n <= BROADCAST_ROWS
                   else attach(out, lookup, [f"__{c}"], "left"))
            missing = (F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col(f"__{c}"))).cast("bigint")
                       if self.unseen == "error" else F.lit(self.unseen).cast("bigint"))
            out = out.withColumn(c, F.coalesce(F.col(f"__code_{c}"), missing))
        return out.select(*[F.col(f"`{c}`") for c in [*kept, *self.code_counts]])

    def decode(self, df: DataFrame, column: str) -> DataFrame:
        """Codes of a column back to its values."""
        lookup = self.codes.where(F.col("column") == column).select(F.col("code").alias(column),
                                                                    F.col("value").alias("__value"))
        return join_on(df, lookup, [column], "left").withColumn(column, F.col("__value")).drop("__value")

    def state(self) -> dict:
        return {"onehot": self.onehot, "code_counts": self.code_counts, "null_as": self.null_as,
                "booleans": self.booleans, "drop_false": self.drop_false, "unseen": self.unseen}

    @classmethod
    def from_state(cls, state: dict, codes: DataFrame) -> "Encoder":
        return cls(codes=codes, **state)


def onehot_encode(df: DataFrame, threshold: int = DEFAULT_THRESHOLD, **options) -> DataFrame:
    """Indicators for columns with at most ``threshold`` values; the rest stay as they are."""
    model = Encoder.fit(df, threshold, **options)
    return Encoder(model.onehot, None, {}, model.null_as, model.booleans, model.drop_false).transform(df)


def label_encode(df: DataFrame, unseen="error") -> DataFrame:
    """Sorted integer codes for every text and boolean column."""
    return Encoder.fit(df, threshold=-1, unseen=unseen).transform(df)


def scale_stats(df: DataFrame, features) -> DataFrame:
    """(feature, mean, std): population deviation, with 0 replaced by 1."""
    features = list(features)
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(features)
                   for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"mean{i}").alias("mean"),
                 F.when(F.col(f"std{i}") == 0, 1.0).otherwise(F.col(f"std{i}")).alias("std"))
        for i, c in enumerate(features)])))


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std for the listed columns; a column without spread becomes 0."""
    return df.select(*[((F.col(f"`{c}`").cast("double") - stats[c][0]) / stats[c][1]).alias(c)
                       if c in stats else F.col(f"`{c}`") for c in df.columns])


def collect_stats(df: DataFrame, features) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["std"]) for r in scale_stats(df, features).collect()}


def _number(name: str):
    """Text as a number; blank is NULL, anything else that is no number an error."""
    text = F.trim(F.col(f"`{name}`").cast("string"))
    bad = F.raise_error(F.concat(F.lit(f"column {name} was numeric when fitted: "), text)).cast("double")
    return F.coalesce(text.try_cast("double"), F.when(text != "", bad))


class Prep:
    """The fitted preparation of a table. ``fit`` learns it, ``transform`` applies it row by row."""

    def __init__(self, id_col, inputs, numeric_text, encoder, features, fillna, stats, scaler=None):
        self.id_col, self.inputs, self.numeric_text, self.encoder = id_col, inputs, numeric_text, encoder
        self.features, self.fillna, self.stats, self.scaler = features, fillna, stats, scaler

    @classmethod
    def fit(cls, df: DataFrame, id_col: str | None = None, features=None, fillna: float = DEFAULT_FILL,
            threshold: int = DEFAULT_THRESHOLD, scaler=None, unseen="error") -> "Prep":
        """``scaler`` may be any Spark ML estimator over a vector column; the default standardises."""
        inputs = [c for c in (features or df.columns) if c != id_col]
        data = df.select(*[F.col(f"`{c}`") for c in inputs])
        numeric_text = numeric_text_columns(data)
        data = data.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in numeric_text})
        encoder = Encoder.fit(data, threshold, skip=(), unseen=unseen)
        filled = cls._fill(encoder.transform(data), fillna)
        model = cls(id_col, inputs, numeric_text, encoder, filled.columns, fillna, {})
        if scaler is None:
            model.stats = collect_stats(filled, filled.columns)
        else:
            vectors = model._vectors(filled)
            model.scaler = scaler.copy({scaler.inputCol: "__v", scaler.outputCol: "__scaled"}).fit(vectors)
        return model

    @staticmethod
    def _fill(df: DataFrame, fillna: float) -> DataFrame:
        return df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fillna))).alias(c)
                           for c in df.columns])

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="__v").transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """The id, when there is one, and the prepared features."""
        keep = [self.id_col] if self.id_col else []
        data = df.select(*[F.col(f"`{c}`") for c in [*keep, *self.inputs]])
        data = data.withColumns({c: _number(c) for c in self.numeric_text})
        data = data.withColumnsRenamed({self.id_col: "__id"}) if keep else data
        coded = self.encoder.transform(data)
        filled = coded.select(*(["__id"] if keep else []), *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(self.fillna))).alias(c) for c in self.features])
        if self.scaler is None:
            out = scale(filled, self.stats)
        else:
            scaled = self.scaler.transform(self._vectors(filled)).withColumn("__a", vector_to_array("__scaled"))
            out = scaled.select(*(["__id"] if keep else []),
                                *[F.get("__a", F.lit(i)).alias(c) for i, c in enumerate(self.features)])
        return out.withColumnsRenamed({"__id": self.id_col}) if keep else out

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables (codes, statistics), a JSON line of settings, and the scaler when there is one."""
        codes = self.encoder.codes if self.encoder.codes is not None else spark.createDataFrame([], _CODES)
        codes.write.mode("overwrite").parquet(f"{path}/codes")
        spark.createDataFrame([(c, *s) for c, s in self.stats.items()], _STATS).write.mode("overwrite").parquet(f"{path}/stats")
        settings = {"id_col": self.id_col, "inputs": self.inputs, "numeric_text": self.numeric_text,
                    "features": self.features, "fillna": self.fillna, "encoder": self.encoder.state(),
                    "scaler": type(self.scaler).__name__ if self.scaler is not None else None}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        if self.scaler is not None:
            self.scaler.write().overwrite().save(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str, scaler_class=None) -> "Prep":
        s = json.loads(spark.read.text(f"{path}/settings").first()[0])
        stats = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/stats").collect()}
        encoder = Encoder.from_state(s["encoder"], spark.read.parquet(f"{path}/codes"))
        if s["scaler"] and scaler_class is None:
            raise ValueError(f"pass scaler_class to load the {s['scaler']}")
        scaler = scaler_class.load(f"{path}/scaler") if s["scaler"] else None
        return cls(s["id_col"], s["inputs"], s["numeric_text"], encoder, s["features"], s["fillna"], stats, scaler)
