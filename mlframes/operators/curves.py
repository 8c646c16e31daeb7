"""ROC, AUC and profit curves in one pass over the scores."""

from pyspark.sql import Column, DataFrame, functions as F

from mlframes.functions.bins import grid_floor
from mlframes.plans.ranks import running_totals

STEPS = 100  # fixed value: thresholds 0.00, 0.01, ..., 1.00


def _histogram(df: DataFrame, label: str, score: str, by, strict: bool) -> DataFrame:
    """(by, hist): per key at most 102 entries (bucket, positives, negatives)."""
    y = F.col(label)
    counts = (df.where(F.col(score).isNotNull()).groupBy(*by, grid_floor(score, strict).alias("bucket"))
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))
    return counts.groupBy(*by).agg(F.collect_list(F.struct("bucket", "pos", "neg")).alias("hist"))


def _total(field: str, i=None) -> Column:
    entries = F.col("hist") if i is None else F.filter("hist", lambda h: h["bucket"] >= i)
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, h: a + h[field])


def _counts_per_threshold(df, label, score, by, strict) -> DataFrame:
    """(by, i, tp, fp, p, n): counts predicted positive at each threshold, and the class totals."""
    per_key = _histogram(df, label, score, list(by), strict)
    grid = per_key.select(*by, F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("i"), "hist")
    return grid.select(*by, "i", _total("pos", F.col("i")).alias("tp"), _total("neg", F.col("i")).alias("fp"),
                       _total("pos").alias("p"), _total("neg").alias("n"))


def roc_curve(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(threshold, tpr, fpr) at 101 thresholds; positive when ``score >= threshold``."""
    c = _counts_per_threshold(df, label, score, by, strict=False)
    return c.select(*by, (F.col("i") * F.lit(0.01)).alias("threshold"),
                    F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"))


def profit_curve(df: DataFrame, label: str, score: str, costbenefit, by=()) -> DataFrame:
    """(threshold, profit): mean of confusion x cost-benefit ``[[tn, fp], [fn, tp]]``; positive when
    ``score > threshold``."""
    (tn, fp), (fn, tp) = [[float(x) for x in row] for row in costbenefit]
    c = _counts_per_threshold(df, label, score, by, strict=True)
    gain = ((F.col("n") - F.col("fp")) * tn + F.col("fp") * fp
            + (F.col("p") - F.col("tp")) * fn + F.col("tp") * tp)
    return c.select(*by, (F.col("i") * F.lit(0.01)).alias("threshold"),
                    F.try_divide(gain, (F.col("p") + F.col("n")).cast("double")).alias("profit"))


def best_threshold(curve: DataFrame, by=()) -> DataFrame:
    """(threshold, profit) at the first maximum of a profit curve."""
    t, profit = F.col("threshold"), F.col("profit")
    return curve.groupBy(*by).agg(F.max_by(t, F.struct(profit, -t)).alias("threshold"),
                                  F.max(profit).alias("profit"))


def auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(auc, auc_hard), rounded to 3.

    ``auc`` is the tie-averaged rank statistic of the scores. ``auc_hard`` takes the class at a
    threshold of one half instead of the score, as a prediction-only curve does.
    """
    by, y = list(by), F.col(label)
    per_score = (df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score"))
                 .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))
    ranked = running_totals(per_score, by, "score", ["neg"])
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    above = F.col("score") >= 0.5
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    tpr = F.try_divide(F.sum(F.when(above, F.col("pos")).otherwise(0)), n_pos)
    fpr = F.try_divide(F.sum(F.when(above, F.col("neg")).otherwise(0)), n_neg)
    return ranked.groupBy(*by).agg(F.round(F.try_divide(wins, n_pos * n_neg), 3).alias("auc"),
                                   F.round((tpr + 1.0 - fpr) / 2.0, 3).alias("auc_hard"))


def model_scores(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(model, label, score) in long form, for curves of several models in one pass (``by=['model']``)."""
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.col(label).alias("label"), F.col(c).alias("score"))
                       for name, c in scores.items()])
    return df.select(F.inline(models))
