"""Differences between two models' confusion matrices and class scores."""

from pyspark.sql import DataFrame, functions as F

from mlframes.operators.metrics import _class_scores, _pair_counts, confusion_matrix


def _both(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """(model, truth, predicted) with both models' predictions; counted before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(truth).cast("string").alias("truth"),
                               F.col(c).cast("string").alias("predicted")) for m, c in ((1, first), (2, second))])
    return df.select(F.inline(pairs))


def delta_matrix(df: DataFrame, truth: str, first: str, second: str, norm: str | None = "recall",
                 unknown: str = "map", unknown_to: str | None = None) -> DataFrame:
    """(truth, predicted, delta): second model's matrix minus the first's."""
    value = "share" if norm else "n"
    both = confusion_matrix(_both(df, truth, first, second), "truth", "predicted", norm, ["model"],
                            unknown, unknown_to)
    sides = both.groupBy("truth", "predicted").agg(*[
        F.sum(F.when(F.col("model") == m, F.col(value))).alias(f"m{m}") for m in (1, 2)])
    missing = F.lit(0)
    return sides.select("truth", "predicted",
                        (F.coalesce("m2", missing) - F.coalesce("m1", missing)).alias("delta"))


def delta_recall_precision(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """(class, delta_recall, delta_precision, recall_1, recall_2) of the true classes.

    Rows whose prediction is no true class are left out, for each model separately.
    """
    pairs = _pair_counts(_both(df, truth, first, second), "truth", "predicted", ["model"], "drop")
    scores = _class_scores(pairs, ["model"]).where("support > 0")
    one, two = ((lambda c, m=m: F.max(F.when(F.col("model") == m, F.col(c)))) for m in (1, 2))
    return scores.groupBy("class").agg(
        (two("recall") - one("recall")).alias("delta_recall"),
        (two("precision") - one("precision")).alias("delta_precision"),
        one("recall").alias("recall_1"), two("recall").alias("recall_2"))
