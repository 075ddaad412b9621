"""Quantile-portfolio evaluation of a factor: group returns, fees, net values, IC, drawdown, indicators.

Functions take aligned cells (tradedate, symbol, factor, fwd) or series made from them; nothing is kept
between calls. Series have one row a period, so windows over all of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import sample_kurtosis, sample_skewness
from ..operators.grid import by_date, by_symbol
from ..operators.panel import average_rank, panel_binning, rank_pct
from ..sources.scratch import written

PERIODS = {"M": 12, "W": 52, "D": 252}


def in_order() -> WindowSpec:
    """All periods of one series, which is as long as the calendar."""
    return W.orderBy("tradedate")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def binned(cells: DataFrame, q: int) -> DataFrame:
    return cells.withColumn("bin", panel_binning(F.col("factor"), q))


def membership_changes(cells: DataFrame) -> DataFrame:
    """Per date: share of the names with a bin whose bin differs from the period before; the first is 0."""
    before = F.lag("bin").over(by_symbol())
    moved = F.col("bin").isNotNull() & ~F.col("bin").eqNullSafe(before)
    by = cells.withColumn("moved", moved).groupBy("tradedate").agg(
        F.try_divide(F.sum(F.col("moved").cast("int")).cast("double"), F.count("bin")).alias("turnover")
    )
    first = F.row_number().over(in_order()) == 1
    return by.withColumn("turnover", F.when(first, 0.0).otherwise(F.coalesce("turnover", F.lit(0.0))))


def group_returns(cells: DataFrame, fee: float = 0.0) -> DataFrame:
    """tradedate, bin (0 = passive: all names with a factor), ret; bins pay fee times the turnover."""
    known = cells.filter("bin is not null")
    bins = known.groupBy("tradedate", "bin").agg(F.avg("fwd").alias("ret"))
    if fee:
        cost = membership_changes(cells).select("tradedate", (F.col("turnover") * fee).alias("cost"))
        bins = bins.join(cost, "tradedate").select("tradedate", "bin", (F.col("ret") - F.col("cost")).alias("ret"))
    passive = known.groupBy("tradedate").agg(F.avg("fwd").alias("ret")).select("tradedate", F.lit(0).alias("bin"), "ret")
    return bins.unionByName(passive)


def sides(groups: DataFrame, q: int) -> DataFrame:
    """tradedate, long (bin q), short (bin 1), long_short, passive."""
    def of(b: int) -> Column:
        return F.max(F.when(F.col("bin") == b, F.col("ret")))

    s = groups.groupBy("tradedate").agg(of(q).alias("long"), of(1).alias("short"), of(0).alias("passive"))
    return s.select("tradedate", "long", "short", (F.col("long") - F.col("short")).alias("long_short"), "passive")


def compounded(x: Column, w: WindowSpec | None = None) -> Column:
    """Running product of 1 + x; unknown returns count as none."""
    return F.product(1 + F.coalesce(x, F.lit(0.0))).over(w or so_far())


def net_values(groups: DataFrame, log: bool = False) -> DataFrame:
    """Running net value of every bin; in log form ln(value) + 1."""
    w = W.partitionBy("bin").orderBy("tradedate").rowsBetween(W.unboundedPreceding, 0)
    value = compounded(F.col("ret"), w)
    return groups.select("tradedate", "bin", (F.ln(value) + 1 if log else value).alias("value"))


def side_net_values(series: DataFrame) -> DataFrame:
    return series.select("tradedate", *[compounded(F.col(c)).alias(c) for c in ("long", "short", "long_short", "passive")])


def log_excess(series: DataFrame) -> DataFrame:
    """Running sums of log returns in excess of the passive one: long, short, and long - short - passive."""
    passive = F.ln(1 + F.col("passive"))
    long, short = F.ln(1 + F.col("long")), F.ln(1 + F.col("short"))
    terms = {"long": long - passive, "short": short - passive, "long_short": long - short - passive}
    return series.select("tradedate", *[F.sum(x).over(so_far()).alias(c) for c, x in terms.items()])


def drawdown(series: DataFrame, c: str = "long") -> DataFrame:
    """Net value of a side and its fall from the highest value so far (0 or less)."""
    value = series.select("tradedate", compounded(F.col(c)).alias("value"))
    return value.withColumn("drawdown", F.try_divide("value", F.max("value").over(so_far())) - 1)


def group_means(groups: DataFrame) -> DataFrame:
    """Mean over time of each bin's return in excess of the bins' average of the date."""
    bins = groups.filter("bin > 0")
    return bins.withColumn("x", F.col("ret") - F.avg("ret").over(by_date())).groupBy("bin").agg(F.avg("x").alias("mean_ret"))


def ic_series(cells: DataFrame, method: str = "spearman") -> DataFrame:
    """Correlation of factor and forward return for each date, on complete pairs."""
    both = cells.filter("factor is not null and fwd is not null")
    if method == "spearman":
        both = both.select("tradedate", average_rank(F.col("factor")).alias("factor"), average_rank(F.col("fwd")).alias("fwd"))
    return both.groupBy("tradedate").agg(F.corr("factor", "fwd").alias("ic"))


def turnover_rate(cells: DataFrame, q: int, freq: str) -> DataFrame:
    """bin, turnover: mean share of a bin's names that were not in it the period before, times periods a year."""
    before = F.lag("bin").over(by_symbol())
    moved = cells.withColumn("new", F.col("bin").isNotNull() & ~F.col("bin").eqNullSafe(before)).filter("bin is not null")
    first = moved.agg(F.min("tradedate").alias("first_date"))
    by = moved.crossJoin(F.broadcast(first)).filter("tradedate > first_date").groupBy("tradedate", "bin").agg(F.avg(F.col("new").cast("double")).alias("share"))
    return by.filter(F.col("bin").isin(1, q)).groupBy("bin").agg((F.avg("share") * PERIODS[freq]).alias("turnover"))


def _annual(x: Column, periods: int) -> Column:
    return F.pow(F.product(1 + F.coalesce(x, F.lit(0.0))), F.lit(float(periods)) / F.count(F.lit(1))) - 1


def _sharpe(x: Column, periods: int) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(periods)))


def indicators(cells: DataFrame, q: int, freq: str = "M", fee: float = 0.0, benchmark: DataFrame | None = None) -> DataFrame:
    """One row with the summary of a factor; benchmark is (tradedate, bench), passive where not given.

    The short side is -bin 1. long_calmar is a Calmar ratio, like the other two.
    """
    p = PERIODS[freq]
    series = sides(group_returns(cells, fee), q)
    series = series.join(benchmark, "tradedate", "left") if benchmark is not None else series.withColumn("bench", F.col("passive"))
    short, excess = -F.col("short"), F.col("long") - F.col("passive")
    worst = series
    for c, x in (("long", F.col("long")), ("short", short), ("long_short", F.col("long_short"))):
        worst = worst.withColumn(f"nv_{c}", compounded(x))
        worst = worst.withColumn(f"dd_{c}", 1 - F.col(f"nv_{c}") / F.max(f"nv_{c}").over(so_far()))
    calmar = {c: F.try_divide(_annual(x, p), F.max(f"dd_{c}")) for c, x in (("long", F.col("long")), ("short", short), ("long_short", F.col("long_short")))}
    deepest = F.max(F.struct(F.col("dd_long").alias("dd"), (-F.unix_date("tradedate")).alias("d")))
    row = worst.agg(
        _annual(F.col("long"), p).alias("long_ret"), _annual(short, p).alias("short_ret"),
        _annual(F.col("long_short"), p).alias("long_short_ret"), _annual(F.col("bench"), p).alias("benchmark_ret"),
        _sharpe(F.col("long"), p).alias("long_sharpe"), _sharpe(short, p).alias("short_sharpe"),
        _sharpe(F.col("long_short"), p).alias("long_short_sharpe"),
        calmar["long"].alias("long_calmar"), calmar["short"].alias("short_calmar"), calmar["long_short"].alias("long_short_calmar"),
        _sharpe(excess, p).alias("info_ratio"),
        (F.stddev_samp("long") * p**0.5).alias("long_vol"), (F.stddev_samp(short) * p**0.5).alias("short_vol"),
        (F.stddev_samp("long_short") * p**0.5).alias("long_short_vol"),
        F.try_divide(F.count_if(F.col("long") > 0).cast("double"), F.count("long")).alias("win_rate"),
        F.try_divide(F.count_if(F.col("long") > F.col("bench")).cast("double"), F.count("long")).alias("win_excess_rate"),
        F.max("dd_long").alias("max_drawdown"),
        F.date_from_unix_date(-deepest["d"]).alias("max_drawdown_end"),
    )
    top = worst.crossJoin(F.broadcast(row.select("max_drawdown_end"))).filter("tradedate <= max_drawdown_end")
    start = top.agg(F.date_from_unix_date(-F.max(F.struct("nv_long", (-F.unix_date("tradedate")).alias("d")))["d"]).alias("max_drawdown_start"))
    n = F.count("ic")
    ic = ic_series(cells).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        sample_skewness(F.col("ic")).alias("ic_skew"), sample_kurtosis(F.col("ic")).alias("ic_kurt"),
        (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * p**0.5).alias("icir"),
        (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(n)).alias("t"),
        F.try_divide(F.count_if(F.col("ic") > 0).cast("double"), n).alias("ic_gt_0"),
    )
    turn = turnover_rate(cells, q, freq).agg(
        F.max(F.when(F.col("bin") == 1, F.col("turnover"))).alias("short_turnover"),
        F.max(F.when(F.col("bin") == q, F.col("turnover"))).alias("long_turnover"),
    )
    # Four tables of one row each.
    out = ic.crossJoin(row).crossJoin(start).crossJoin(turn)
    return out.withColumn("max_drawdown_duration", F.datediff("max_drawdown_end", "max_drawdown_start"))


def last_factor_view(factor: DataFrame, pool: DataFrame | None, names: DataFrame | None = None) -> DataFrame:
    """Values of the last date in the pool with their percentile rank, and names where given."""
    known = factor.filter("value is not null")
    if pool is not None:
        # The pool's values are few and are read twice.
        known = written(known.join(pool, ["tradedate", "symbol"], "left_semi"))
    last = known.join(F.broadcast(known.agg(F.max("tradedate").alias("tradedate"))), "tradedate")
    out = last.withColumn("pct", rank_pct(F.col("value")))
    return out.join(names, "symbol", "left") if names is not None else out
