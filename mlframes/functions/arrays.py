"""Ranking and arg-max expressions over arrays."""

from functools import reduce

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def average_precision(actual, predicted, k: int = 5) -> Column:
    """Average precision at k. A repeated prediction counts once; an empty ``actual`` gives 0."""
    actual, shown = _col(actual), F.slice(_col(predicted), 1, k)
    hit = F.transform(shown, lambda p, i: F.array_contains(actual, p) & (F.array_position(shown, p) == i + 1))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("hits"), F.lit(0.0).alias("score"))

    def step(acc, h):
        h = F.coalesce(h, F.lit(False))
        seen, hits = acc["seen"] + 1.0, acc["hits"] + h.cast("double")
        return F.struct(seen.alias("seen"), hits.alias("hits"),
                        (acc["score"] + F.when(h, hits / seen).otherwise(0.0)).alias("score"))

    total = F.aggregate(hit, start, step, lambda acc: acc["score"])
    return F.when(F.size(actual) > 0, total / F.least(F.size(actual), F.lit(k))).otherwise(F.lit(0.0))


def top_n_classes(probabilities, n: int = 5) -> Column:
    """Positions of the n largest entries, largest first; ties go to the higher position."""
    ranked = F.array_sort(F.transform(_col(probabilities), lambda p, i: F.struct((-p).alias("p"), (-i).alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: (-s["i"]).cast("int"))


def class_names(positions, classes) -> Column:
    """Names for class positions."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(_col(positions), lambda i: F.get(names, i))


def argmax_column(columns) -> Column:
    """Name of the column holding the row maximum; the first one wins a tie."""
    columns = list(columns)
    if len(columns) == 1:
        return F.lit(columns[0])
    top = F.greatest(*[F.col(c) for c in columns])
    return reduce(lambda acc, c: acc.when(F.col(c) == top, F.lit(c)), columns[1:],
                  F.when(F.col(columns[0]) == top, F.lit(columns[0])))


def interpolate(below, above, share) -> Column:
    """Value at ``share`` of the way; measured from the nearer end, so equal ends give exactly that value."""
    gap = above - below
    return F.when(share < 0.5, below + gap * share).otherwise(above - gap * (1.0 - share))


def _quantile_sql(a: str, p: float) -> str:
    position = f"((size({a}) - 1) * {float(p)!r}D)"
    share = f"({position} - floor({position}))"
    below = f"get({a}, cast(greatest(floor({position}), 0) as int))"
    above = f"get({a}, cast(least(floor({position}) + 1, size({a}) - 1) as int))"
    return (f"if({share} < 0.5D, {below} + ({above} - {below}) * {share}, "
            f"{above} - ({above} - {below}) * (1D - {share}))")


def sorted_quantile(column: str, p: float) -> Column:
    """Quantile of an ascending array without nulls, with linear interpolation; NULL when empty."""
    return F.expr(_quantile_sql(column, p))


def interquartile_mean(column: str) -> Column:
    """Mean of the entries strictly between the quartiles of an ascending array; NULL when there is none.

    The quartiles travel in the accumulator: a lambda that named them would work them out per entry.
    """
    inside = "x > acc.lo and x < acc.hi"
    return F.expr(
        f"aggregate({column}, named_struct('lo', {_quantile_sql(column, 0.25)}, 'hi', {_quantile_sql(column, 0.75)}, "
        f"'s', 0D, 'n', 0), (acc, x) -> named_struct('lo', acc.lo, 'hi', acc.hi, 's', acc.s + if({inside}, x, 0D), "
        f"'n', acc.n + if({inside}, 1, 0)), acc -> try_divide(acc.s, acc.n))")
