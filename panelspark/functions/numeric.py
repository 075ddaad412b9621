"""Numeric conventions that all operators share: NULL is the only missing value.

NaN and infinities become NULL at every source; a division by zero is NULL; ranks of ties are averages;
skewness and kurtosis are corrected for sample size.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def gated(value: Column, x: Column, least: int, w: WindowSpec) -> Column:
    """value where the frame holds at least `least` known x, else NULL."""
    return F.when(F.count(x).over(w) >= least, value)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x held between two bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def both_greatest(*xs: Column) -> Column:
    """Greatest value, NULL if any is NULL."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.greatest(*xs))


def both_least(*xs: Column) -> Column:
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.least(*xs))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness of a group (NULL below three values)."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis of a group (NULL below four values)."""
    n = F.count(x)
    top = ((n + 1) * F.kurtosis(x) + 6) * (n - 1)
    return F.when(n > 3, F.try_divide(top, (n - 2) * (n - 3)))
