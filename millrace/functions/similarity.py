"""Pair measures between two columns, for grouped tables and moving frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.stats import Over, plain

# fixed values: names of the measures
TABLE_MEASURES = (
    "chi phi kappa jaccard support lift confMax confMin convMax convMin yuleQ yuleY oddsRatio"
).split()
MOMENT_MEASURES = "covar ucovar pearson cosine euclid cityblock hamming".split()
RANK_MEASURES = ["spearman", "kendall"]
MEASURES = MOMENT_MEASURES + RANK_MEASURES + TABLE_MEASURES
MOVING_MEASURES = (
    "covar ucovar pearson spearman kendall cosine euclid cityblock hamming chi phi jaccard support lift"
).split()


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(x: Column, y: Column, over: Over = plain) -> Column:
    """Correlation without corr(), which raises on constant data."""
    return _div(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))


def pair(measure: str, left: Column, right: Column, over: Over = plain) -> Column:
    """A measure that is a function of sums; rows with a NULL on either side drop out."""
    both = left.isNotNull() & right.isNotNull()
    x, y = F.when(both, left.cast("double")), F.when(both, right.cast("double"))
    if measure == "covar":
        return over(F.covar_pop(x, y))
    if measure == "ucovar":
        return over(F.covar_samp(x, y))
    if measure == "pearson":
        return pearson(x, y, over)
    if measure == "cosine":
        return _div(over(F.sum(x * y)), F.sqrt(over(F.sum(x * x))) * F.sqrt(over(F.sum(y * y))))
    if measure == "euclid":
        return F.sqrt(over(F.sum((x - y) * (x - y))))
    if measure == "cityblock":
        return over(F.sum(F.abs(x - y)))
    if measure == "hamming":
        return over(F.avg((x != y).cast("double")))
    if measure in TABLE_MEASURES:
        return _table(measure, x == 1, y == 1, over)
    raise ValueError(f"unknown measure {measure!r}")


def _table(measure: str, p: Column, q: Column, over: Over) -> Column:
    """Measures of the 2x2 table of two flags (value 1 is set, anything else is not)."""
    def cell(cond: Column) -> Column:
        return over(F.count(F.when(cond, 1))).cast("double")

    a, b, c, d = cell(p & q), cell(p & ~q), cell(~p & q), cell(~p & ~q)
    n = a + b + c + d
    phi = _div(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))
    conf = _div(a, a + b), _div(a, a + c)
    conv = _div(1 - (a + c) / n, 1 - conf[0]), _div(1 - (a + b) / n, 1 - conf[1])
    expected = ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    root_ad, root_bc = F.sqrt(a * d), F.sqrt(b * c)
    # NULL when either direction is undefined
    both = lambda pick, v: F.when(v[0].isNotNull() & v[1].isNotNull(), pick(v[0], v[1]))
    value = {
        "chi": n * phi * phi,
        "phi": phi,
        "kappa": _div((a + d) / n - expected, 1 - expected),
        "jaccard": _div(a, a + b + c),
        "support": a / n,
        "lift": _div(a * n, (a + b) * (a + c)),
        "confMax": both(F.greatest, conf),
        "confMin": both(F.least, conf),
        "convMax": both(F.greatest, conv),
        "convMin": both(F.least, conv),
        "yuleQ": _div(a * d - b * c, a * d + b * c),
        "yuleY": _div(root_ad - root_bc, root_ad + root_bc),
        "oddsRatio": _div(a * d, b * c),
    }[measure]
    return F.when(n > 0, value)


def frame_ranks(measure: str, left: Column, right: Column, over: Over) -> Column:
    """Spearman and Kendall tau-b inside a moving frame, over the frame's own array.

    The frame length is a caller's parameter, so the quadratic array work is bounded.
    """
    both = left.isNotNull() & right.isNotNull()
    frame = over(F.collect_list(F.when(both, F.struct(left.cast("double").alias("x"), right.cast("double").alias("y")))))

    def total(arr: Column, f) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + f(v))

    if measure == "kendall":
        def signs(of):
            return total(frame, lambda p: total(frame, lambda q: of(F.signum(q["x"] - p["x"]), F.signum(q["y"] - p["y"]))))

        return _div(signs(lambda s, t: s * t), F.sqrt(signs(lambda s, t: s * s) * signs(lambda s, t: t * t)))

    def centred(side: str):
        # twice (average rank - mean rank) = #smaller - #larger
        return lambda p: total(frame, lambda q: F.signum(p[side] - q[side]))

    ranks = F.transform(frame, lambda p: F.struct(centred("x")(p).alias("u"), centred("y")(p).alias("v")))
    return _div(
        total(ranks, lambda r: r["u"] * r["v"]),
        F.sqrt(total(ranks, lambda r: r["u"] * r["u"]) * total(ranks, lambda r: r["v"] * r["v"])),
    )
