"""Evaluation metrics as single aggregations."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from mlframes.functions.arrays import average_precision
from mlframes.plans.joins import join_on
from mlframes.plans.ranks import dense_codes


def _share(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# ---- confusion ---------------------------------------------------------------------------------

def _pair_counts(df, truth, predicted, by, unknown="keep", unknown_to=None):
    """(by, truth, predicted, n). Unknown predictions are those that never occur as truth."""
    pairs = (df.groupBy(*by, F.col(truth).cast("string").alias("truth"),
                        F.col(predicted).cast("string").alias("predicted"))
             .agg(F.count("*").alias("n")))
    if unknown == "keep":
        return pairs
    known = pairs.select(*by, F.col("truth").alias("predicted")).distinct().withColumn("known", F.lit(True))
    marked = join_on(pairs, known, [*by, "predicted"], "left")
    if unknown == "drop":
        return marked.where("known").drop("known")
    if unknown != "map":
        raise ValueError("unknown must be 'keep', 'drop' or 'map'")
    return (marked.withColumn("predicted", F.when(F.col("known"), F.col("predicted")).otherwise(F.lit(unknown_to)))
            .groupBy(*by, "truth", "predicted").agg(F.sum("n").alias("n")))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, norm: str | None = None, by=(),
                     unknown: str = "keep", unknown_to: str | None = None) -> DataFrame:
    """(truth, predicted, n[, share]) with a row for every pair of classes.

    ``norm='recall'`` divides by the truth row, ``'precision'`` by the predicted column. ``by`` gives
    one matrix per key. ``unknown='drop'`` leaves out rows whose prediction is no true class,
    ``'map'`` counts them under ``unknown_to``. NULL is a class like any other. Data rows are counted once; what follows works on counts.
    """
    by = list(by)
    counts = _pair_counts(df, truth, predicted, by, unknown, unknown_to)
    classes = counts.groupBy(*by).agg(
        F.array_union(F.collect_set(F.struct(F.col("truth").alias("c"))),  # a struct keeps the NULL class
                      F.collect_set(F.struct(F.col("predicted").alias("c")))).alias("classes"))
    grid = (classes.select(*by, F.explode("classes").alias("t"), "classes")
            .select(*by, F.col("t.c").alias("truth"), F.explode("classes").alias("p"))
            .select(*by, "truth", F.col("p.c").alias("predicted")))
    full = (join_on(grid, counts, [*by, "truth", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    if norm is None:
        return full
    side = {"recall": "truth", "precision": "predicted"}[norm]
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*by, side))))


def binary_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (tn, fp, fn, tp) for 0/1 labels."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
                  F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def _class_scores(pairs: DataFrame, by=()) -> DataFrame:
    """(by, class, support, recall, precision, f1) from (by, truth, predicted, n)."""
    by = list(by)
    sides = pairs.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("hit")))))
    sums = sides.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("shown"),
                                           F.sum("hit").alias("hit"))
    return sums.select(*by, "class", "support",
                       _share(F.col("hit"), F.col("support")).alias("recall"),
                       _share(F.col("hit"), F.col("shown")).alias("precision"),
                       _share(2.0 * F.col("hit"), F.col("support") + F.col("shown")).alias("f1"))


def _weighted(scores: DataFrame, by=()) -> DataFrame:
    by = list(by)
    total = F.sum("support")
    return scores.groupBy(*by).agg(*[
        F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")],
        total.alias("support"))


TOTAL_ROW = "avg / total"  # fixed value: name of the summary row


def class_report(df: DataFrame, truth: str, predicted: str, unknown: str = "keep",
                 unknown_to: str | None = None) -> DataFrame:
    """(class, precision, recall, f1, support) per class and a support-weighted last row."""
    scores = _class_scores(_pair_counts(df, truth, predicted, [], unknown, unknown_to))
    total = _weighted(scores).withColumn("class", F.lit(TOTAL_ROW))
    columns = ["class", "precision", "recall", "f1", "support"]
    return scores.select(*columns).unionByName(total.select(*columns))


def recall_precision(df: DataFrame, truth: str, predicted: str, unknown: str = "drop") -> DataFrame:
    """(class, recall, precision, support) of the true classes."""
    scores = _class_scores(_pair_counts(df, truth, predicted, [], unknown))
    return scores.where("support > 0").select("class", "recall", "precision", "support")


CLASS_METRICS = ["precision", "recall", "f1", "accuracy"]


def classification_metrics(df: DataFrame, truth: str, predicted: str, split: str = "split",
                           metrics=None) -> DataFrame:
    """(set, metric, value): support-weighted precision, recall and f1, and accuracy, per split."""
    pairs = _pair_counts(df, truth, predicted, [split])
    weighted = _weighted(_class_scores(pairs, [split]), [split])
    accuracy = pairs.groupBy(split).agg(F.try_divide(
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return _long(join_on(weighted, accuracy, [split]), split, metrics or CLASS_METRICS)


def _long(wide: DataFrame, split: str, metrics) -> DataFrame:
    return wide.unpivot([split], list(metrics), "metric", "value").withColumnRenamed(split, "set")


# ---- regression --------------------------------------------------------------------------------

def _mape(y, p, zero: str) -> Column:
    part = F.abs(F.try_divide(y - p, y))
    if zero == "inf":
        # a zero actual with an error is infinite, with no error undefined
        part = F.when((y == 0) & (p != 0), F.lit(float("inf"))).when((y == 0) & (p == 0), F.lit(float("nan"))).otherwise(part)
    return F.avg(part) * 100.0


def mape(df: DataFrame, actual: str, predicted: str, zero: str = "skip") -> DataFrame:
    """One row (mape, n_zero). Zero actuals are skipped and counted; ``zero='inf'`` lets them through."""
    y, p = F.col(actual), F.col(predicted)
    return df.agg(_mape(y, p, zero).alias("mape"), F.count_if(y == 0).alias("n_zero"))


REGRESSION_METRICS = ["mae", "rmse", "mape", "explained_variance"]


def regression_metrics(df: DataFrame, actual: str, predicted: str, split: str = "split", metrics=None,
                       zero: str = "skip") -> DataFrame:
    """(set, metric, value) per split, from one aggregation."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    wide = df.groupBy(split).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), _mape(y, p, zero).alias("mape"),
        (1.0 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"))
    return _long(wide, split, metrics or REGRESSION_METRICS)


def fuzzy_bands(df: DataFrame, actual: str, predicted: str, std: str, two_sigma: bool = False) -> DataFrame:
    """Add bounds, membership and ``which_std``: 0 inside actual +/- std, 1 inside the wider band, else 2.

    The wider band doubles the bounds themselves; ``two_sigma=True`` makes it actual +/- 2 std.
    """
    y, p, s = F.col(actual), F.col(predicted), F.col(std)
    low, high = y - s, y + s
    wide_low, wide_high = (y - 2 * s, y + 2 * s) if two_sigma else (low * 2, high * 2)
    within = F.coalesce((p > low) & (p < high), F.lit(False))
    wider = F.coalesce((p > wide_low) & (p < wide_high), F.lit(False))
    return df.withColumns({"lower_bound": low, "upper_bound": high, "within_std": within, "within_2std": wider,
                           "which_std": F.when(within, 0).when(wider, 1).otherwise(2)})


def fuzzy_accuracy(df: DataFrame, actual: str, predicted: str, std: str, two_sigma: bool = False) -> DataFrame:
    """One row: the share of predictions strictly inside actual +/- std."""
    return fuzzy_bands(df, actual, predicted, std, two_sigma).agg(
        F.avg(F.col("within_std").cast("double")).alias("accuracy"))


# ---- ranking and comparison --------------------------------------------------------------------

def mean_average_precision(df: DataFrame, actual: str, predicted: str, k: int = 5) -> DataFrame:
    return df.agg(F.avg(average_precision(actual, predicted, k)).alias("map_at_k"))


def accuracy_table(df: DataFrame, truth: str, predictions: dict[str, str]) -> DataFrame:
    """(Classifier, Test Accuracies) for models whose predictions are columns of one table."""
    models = F.array(*[F.struct(F.lit(name).alias("Classifier"),
                                (F.col(truth) == F.col(column)).cast("double").alias("hit"))
                       for name, column in predictions.items()])
    return df.select(F.inline(models)).groupBy("Classifier").agg(F.avg("hit").alias("Test Accuracies"))


def class_codes(df: DataFrame, column: str) -> DataFrame:
    """(class, code): integers of the sorted distinct classes."""
    classes = df.select(F.col(column).alias("class")).where(F.col("class").isNotNull()).distinct()
    return dense_codes(classes, "class")


def actual_std_predicted(actuals: DataFrame, predictions: DataFrame, key) -> DataFrame:
    """Actual, deviation and prediction side by side, matched on a key."""
    key = [key] if isinstance(key, str) else list(key)
    return join_on(actuals, predictions, key)
