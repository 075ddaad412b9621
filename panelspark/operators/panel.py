"""Cross-sectional operators: the symbols of one date, as window expressions over tradedate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite, nonzero
from ..sources.scratch import written
from .grid import by_date


def panel_rank(x: Column) -> Column:
    """Ordinal rank from 0 within the date; ties in the order of symbol; NULL stays NULL."""
    order = by_date().orderBy(F.isnull(x), x, "symbol")
    return F.when(x.isNotNull(), F.row_number().over(order) - 1)


def average_rank(x: Column, keys: tuple[str, ...] = ("tradedate",)) -> Column:
    """Rank from 1 with ties at their average; NULL stays NULL."""
    order = W.partitionBy(*keys).orderBy(F.isnull(x), x)
    # The first and the last place of the ties, by one sort.
    last = F.count(F.lit(1)).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + last) / 2.0)


def rank_pct(x: Column) -> Column:
    return average_rank(x) / F.count(x).over(by_date())


def _pair(y: Column, x: Column) -> tuple[Column, Column]:
    both = y.isNotNull() & x.isNotNull()
    return F.when(both, y), F.when(both, x)


def orthogonalize(y: Column, x: Column) -> Column:
    """Residual of y on x by ordinary least squares among the date's symbols."""
    y, x = _pair(y, x)
    return y - F.regr_slope(y, x).over(by_date()) * x - F.regr_intercept(y, x).over(by_date())


def panel_reg_residual(y: Column, x: Column, least_share: float = 0.05) -> Column:
    """As orthogonalize, NULL on dates where fewer than least_share of the rows know both."""
    py, px = _pair(y, x)
    enough = F.count(py).over(by_date()) >= least_share * F.count(F.lit(1)).over(by_date())
    return F.when(enough, orthogonalize(y, x))


def panel_binning(x: Column, q: int = 5) -> Column:
    """Bin 1..q by the date's interpolated quantiles: the number of edges at or below x, at most q."""
    edges = F.percentile(x, [i / q for i in range(q + 1)]).over(by_date())
    bins = F.size(F.filter(edges, lambda e: e <= x))
    return F.when(x.isNotNull(), F.least(bins, F.lit(q)))


def with_winsorized(df: DataFrame, c: str, width: float = 5.0) -> DataFrame:
    """Clip column c to the date's median +- width times its median absolute deviation, in two passes."""
    middle = df.withColumn("_middle", F.median(c).over(by_date()))
    spread = middle.withColumn("_mad", F.median(F.abs(F.col(c) - F.col("_middle"))).over(by_date()))
    held = clip(F.col(c), F.col("_middle") - width * F.col("_mad"), F.col("_middle") + width * F.col("_mad"))
    return spread.withColumn(c, held).drop("_middle", "_mad")


def normalize(x: Column) -> Column:
    """z-score within the date (sample deviation)."""
    return F.try_divide(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date()))


def with_standard(df: DataFrame, c: str) -> DataFrame:
    """Winsorize, then normalize column c."""
    return with_winsorized(df, c).withColumn(c, normalize(F.col(c)))


#: Values that a bracket may hold when they are put in order; brackets of more are narrowed by another pass.
BRACKET = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], most: int = BRACKET) -> dict[str, list[float | None]]:
    """Exact (interpolated) quantiles of columns over the whole table; df is read a few times, so it should be written.

    Each wanted rank has a bracket of values, at first all. A pass takes two values around it from a sketch, counts
    the values below, within and above, and keeps the part that holds the rank, so brackets narrow by a factor of
    thousands a pass. Brackets of at most `most` values are put in order. Only such and a few numbers a rank leave the tasks.
    """
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    ranks = {(c, k) for c in columns for q in shares if sizes[c] for k in (math.floor(q * (sizes[c] - 1)), math.ceil(q * (sizes[c] - 1)))}
    # Of each rank: least and greatest value of its bracket (none: open), values below it, values in it.
    open_ = {r: (None, None, 0, sizes[r[0]]) for r in ranks}
    found: dict[tuple[str, int], float] = {}

    def within(c: str, low: float | None, high: float | None) -> Column:
        return F.col(c).isNotNull() & (F.lit(True) if low is None else F.col(c).between(F.lit(low), F.lit(high)))

    while open_:
        wide = sorted(r for r, b in open_.items() if b[3] > most)
        near = sorted(r for r, b in open_.items() if b[3] <= most)
        if near:
            got = df.agg(*[F.collect_list(F.when(within(r[0], *open_[r][:2]), F.col(r[0]))).alias(f"_{i}") for i, r in enumerate(near)]).first()
            for i, r in enumerate(near):
                found[r] = sorted(got[i])[r[1] - open_.pop(r)[2]]
        if wide:
            # A sketch errs by a 10,000th of the bracket's values at most, the sides leave ten times that.
            sides = []
            for i, r in enumerate(wide):
                low, high, below, n = open_[r]
                at = (r[1] - below + 0.5) / n
                inside = F.when(within(r[0], low, high), F.col(r[0]))
                sides.append(F.percentile_approx(inside, [min(max(at + d, 0.0), 1.0) for d in (-1e-3, 1e-3)], 10_000).alias(f"_{i}"))
            edges = df.agg(*sides).first()
            parts = []
            for i, r in enumerate(wide):
                (a, b), mine = edges[i], within(r[0], *open_[r][:2])
                x = F.col(r[0])
                parts += [F.count_if(mine & (x < a)), F.count_if(mine & x.between(a, b)), F.min(F.when(mine, x)), F.max(F.when(mine & (x < a), x)), F.min(F.when(mine & (x > b), x)), F.max(F.when(mine, x)), F.count_if(mine & (x == a)), F.min(F.when(mine & (x > a), x))]
            counts = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).first()
            for i, r in enumerate(wide):
                (a, b), (less, mid, least, under, over, greatest, equal, next_) = edges[i], counts[8 * i : 8 * i + 8]
                _, _, below, n = open_[r]
                if r[1] < below + less:
                    open_[r] = (least, under, below, less)
                elif r[1] < below + less + equal:
                    open_[r] = (a, a, below + less, equal)
                elif r[1] < below + less + mid:
                    # Without the copies of the least value a bracket of few values narrows too.
                    open_[r] = (next_, b, below + less + equal, mid - equal)
                else:
                    open_[r] = (over, greatest, below + less + mid, n - less - mid)
                if open_[r][0] == open_[r][1]:
                    found[r] = open_.pop(r)[0]
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for q in shares:
            at = q * (sizes[c] - 1) if sizes[c] else None
            out[c].append(None if at is None else found[c, math.floor(at)] + (found[c, math.ceil(at)] - found[c, math.floor(at)]) * (at - math.floor(at)))
    return out


def quartiles(df: DataFrame, c: str) -> DataFrame:
    """One row with _q1 and _q3, the exact (interpolated) quartiles of a column over the whole table."""
    return df.sparkSession.createDataFrame([tuple(quantiles(df, [c], (0.25, 0.75))[c])], "_q1 double, _q3 double")


def with_cleaned(df: DataFrame, *columns: str) -> DataFrame:
    """0, NaN and infinity to NULL, clip to the global quartiles -+ 1.5 times their distance, z-score by date.

    The table is written to the shared folder first, as the quartiles and the result all read it.
    """
    held = written(df.withColumns({c: nonzero(finite(F.col(c))) for c in columns}))
    for c, (q1, q3) in quantiles(held, columns, (0.25, 0.75)).items():
        if q1 is not None:
            span = 1.5 * (q3 - q1)
            held = held.withColumn(c, clip(F.col(c), F.lit(q1 - span), F.lit(q3 + span)))
    return held.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(by_date()), F.stddev_pop(c).over(by_date())) for c in columns})


def sector_filled(x: Column, sector: str = "sector") -> Column:
    """x, or the median of its date and sector."""
    return F.coalesce(x, F.median(x).over(W.partitionBy("tradedate", sector)))


def top_share(x: Column, share: float = 0.99) -> Column:
    """1 for the date's largest values that together reach the share (the one that crosses it too)."""
    order = by_date().orderBy(F.desc_nulls_last(x), "symbol")
    before = F.coalesce(F.sum(x).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return F.when(x.isNotNull() & (before < share * F.sum(x).over(by_date())), 1)


def listed_days(x: Column) -> Column:
    """Calendar days since the symbol's first known value, counted from 1; 0 or less before it."""
    first = F.min(F.when(x.isNotNull(), F.col("tradedate"))).over(W.partitionBy("symbol"))
    return F.datediff("tradedate", first) + 1


def share_of_date(x: Column) -> Column:
    return F.try_divide(x, F.sum(x).over(by_date()))


def run(df: DataFrame, *steps) -> DataFrame:
    """Apply steps (functions of a DataFrame) one after the other."""
    for step in steps:
        df = df.transform(step)
    return df
