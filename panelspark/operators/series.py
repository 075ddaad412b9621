"""Rolling operators down the dates of each symbol, as window expressions.

`least` is the number of known values a frame needs. All take columns of a dense panel and return one.
They reduce the frame anew for every row, which is right for short frames; `moving` has the long ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import both_greatest, both_least, gated, ratio
from .grid import lag, trailing


def ts_mean(x: Column, n: int = 10, least: int | None = None) -> Column:
    w = trailing(n)
    return gated(F.avg(x).over(w), x, least or n, w)


def ts_sum(x: Column, n: int = 10, least: int | None = None) -> Column:
    w = trailing(n)
    return gated(F.sum(x).over(w), x, least or n, w)


def ts_stddev(x: Column, n: int = 10, least: int | None = None, ddof: int = 1) -> Column:
    """Needs a tenth of the frame by default, and more than ddof values."""
    w = trailing(n)
    least = max(least or max(1, n // 10), ddof + 1)
    return gated((F.stddev_samp if ddof else F.stddev_pop)(x).over(w), x, least, w)


def ts_cov(x: Column, y: Column, n: int = 10, least: int | None = None) -> Column:
    """Sample covariance of the pairs known in the frame."""
    w, both = trailing(n), F.when(x.isNotNull() & y.isNotNull(), x)
    return gated(F.covar_samp(x, y).over(w), both, max(2, least or n // 10), w)


def ts_corr_pearson(x: Column, y: Column, n: int = 10) -> Column:
    w, known = trailing(n), x.isNotNull() & y.isNotNull()
    a, b = F.when(known, x), F.when(known, y)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return gated(F.try_divide(F.covar_pop(a, b).over(w), spread), a, n, w)


def ts_prod(x: Column, n: int = 10, least: int | None = None) -> Column:
    """Product of the known values, zeros included."""
    w = trailing(n)
    return gated(F.product(x).over(w), x, least or n, w)


def ts_min(x: Column, n: int, least: int | None = None) -> Column:
    w = trailing(n)
    return gated(F.min(x).over(w), x, least or n, w)


def ts_max(x: Column, n: int, least: int | None = None) -> Column:
    """The frame needs `least` rows, known or not."""
    w = trailing(n)
    return F.when(F.count(F.lit(1)).over(w) >= (least or n), F.max(x).over(w))


def delta(x: Column, n: int) -> Column:
    return x - lag(x, n)


def ts_argmax(x: Column, n: int, row: Column, least: int | None = None) -> Column:
    """Grid row (from 1) of the frame's first greatest value; row counts the symbol's rows from 0."""
    w = trailing(n)
    found = F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-row).alias("r")))).over(w)["r"]
    return gated(1 - found, x, least or n, w)


def ts_argmin(x: Column, n: int, row: Column, least: int | None = None) -> Column:
    w = trailing(n)
    found = F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), row.alias("r")))).over(w)["r"]
    return gated(found + 1, x, least or n, w)


def ts_rank(x: Column, n: int, least: int | None = None) -> Column:
    """Average rank of the current value among the known ones of its frame (short frames)."""
    w = trailing(n)
    values = F.collect_list(x).over(w)
    rank = F.size(F.filter(values, lambda v: v < x)) + (F.size(F.filter(values, lambda v: v == x)) + 1) / 2.0
    return F.when(x.isNotNull(), gated(rank, x, least or n, w))


def ts_coef_var(x: Column, n: int) -> Column:
    """Population deviation over the mean of a frame that is known in full."""
    w = trailing(n)
    return gated(ratio(F.stddev_pop(x).over(w), F.avg(x).over(w)), x, n, w)


def ts_zscore(x: Column, n: int) -> Column:
    """Distance from the mean in sample deviations of a frame that is known in full."""
    w = trailing(n)
    return gated(ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), x, n, w)


def lagged_range(x: Column, step: int, times: int) -> tuple[Column, Column]:
    """Greatest and least of x at lags 0, step, .., NULL if one of them is."""
    lags = [lag(x, step * i) for i in range(times)]
    return both_greatest(*lags), both_least(*lags)
