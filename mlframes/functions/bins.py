"""Binning expressions."""

from pyspark.sql import Column, functions as F

# Rating edges and the interval labels users see for them.
RATING_EDGES = [0.0, 3.99, 4.99, 5.0]
RATING_LABELS = ["(-0.001, 3.99]", "(3.99, 4.99]", "(4.99, 5.0]"]
MISSING = "Missing"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bin_right_closed(c, edges, labels=None, missing=MISSING) -> Column:
    """Label of the right-closed interval holding the value; the first one also holds its lower edge.

    With ``labels=None`` the result is the bin number, 1-based, and NULL outside.
    """
    c = _col(c)
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        value = F.lit(labels[i]) if labels else F.lit(i + 1)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out.otherwise(F.lit(missing)) if labels else out


def rating_bin(c) -> Column:
    return bin_right_closed(c, RATING_EDGES, RATING_LABELS)


def equal_width_bin(c, low, high, bins: int) -> Column:
    """0-based bin of an equal-width histogram over [low, high]; the last bin is closed, outside is NULL.

    ``low`` and ``high`` may be numbers or columns. A zero-width range puts everything in bin 0.
    """
    c = _col(c)
    low = F.lit(float(low)) if isinstance(low, (int, float)) else low
    high = F.lit(float(high)) if isinstance(high, (int, float)) else high
    position = F.coalesce(F.floor(F.try_divide((c - low) * bins, high - low)), F.lit(0))
    return F.when((c >= low) & (c <= high), F.least(position, F.lit(bins - 1)).cast("int"))


def grid_floor(p, strict=False) -> Column:
    """Largest i in -1..100 with ``i * 0.01 <= p`` (``< p`` when strict).

    ``floor(p * 100)`` is off by one for some doubles, so its neighbours are compared as well.
    """
    p = _col(p)
    guess = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), p)) * 100)))
    guess = guess.cast("int")

    def reached(i):
        edge = i * F.lit(0.01)
        return (edge < p) if strict else (edge <= p)

    return (F.when(F.isnan(p), F.lit(-1))
            .when((guess < 100) & reached(guess + 1), guess + 1)
            .when((guess >= 0) & reached(guess), guess)
            .when((guess >= 1) & reached(guess - 1), guess - 1)
            .otherwise(F.lit(-1)))
