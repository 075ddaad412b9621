"""Dense (tradedate, symbol) grids, fills and point-in-time alignment.

lag() and row frames count the rows of the grid, so a panel is laid on calendar x assets first. Both
sides of that product are small dimensions; their size is checked before the calendar is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A calendar of more days than this is not broadcast (it would span 2,700 years).
MOST_DAYS = 1_000_000

def by_symbol() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("tradedate")


def backwards() -> WindowSpec:
    """Days from the last to the first, for frames to a symbol's last row: up the dates Spark reduces these anew for every row."""
    return W.partitionBy("symbol").orderBy(F.desc("tradedate"))


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


def trailing(n: int) -> WindowSpec:
    """The last n rows of a symbol, with the current one."""
    return by_symbol().rowsBetween(1 - n, 0)


def by_date() -> WindowSpec:
    return W.partitionBy("tradedate")


def grid(calendar: DataFrame, assets: DataFrame) -> DataFrame:
    days, symbols = calendar.select("tradedate").distinct(), assets.select("symbol").distinct()
    if days.count() > MOST_DAYS:
        return symbols.crossJoin(days)
    return symbols.crossJoin(F.broadcast(days))


def densify(panel: DataFrame | None, calendar: DataFrame | None = None, assets: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """The panel (one row a day and symbol) on every day and asset; cells without a row are NULL, rows off the grid go.

    reports (tradedate, symbol, fields of their own names) are laid beside it point in time: each field has its
    latest known value, from a day without trading too. Grid, panel and reports are put together and grouped rather
    than joined: one shuffle by symbol serves the grouping and the windows down the dates that follow.
    """
    both = grid(calendar or panel, assets or panel).withColumn("_on_grid", F.lit(True))
    for part in (panel, reports):
        both = both.unionByName(part, allowMissingColumns=True) if part is not None else both
    fields = [c for c in both.columns if c not in ("tradedate", "symbol", "_on_grid")]
    both = both.repartition("symbol").groupBy("tradedate", "symbol")
    one = both.agg(F.max("_on_grid").alias("_on_grid"), *[F.first(c, ignorenulls=True).alias(c) for c in fields])
    if reports is not None:
        one = one.withColumns({c: ffill(F.col(c)) for c in reports.columns if c not in ("tradedate", "symbol")})
    return one.filter("_on_grid").drop("_on_grid")


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def bfill(x: Column) -> Column:
    """The next known value; looks ahead in time."""
    return F.last(x, ignorenulls=True).over(backwards().rowsBetween(W.unboundedPreceding, 0))


def lag(x: Column, n: int) -> Column:
    """Value n grid rows earlier; a negative n looks ahead."""
    return F.lag(x, n).over(by_symbol()) if n >= 0 else F.lead(x, -n).over(by_symbol())


def change(x: Column, n: int) -> Column:
    """x / x n rows earlier - 1, NULL on a zero base."""
    return F.try_divide(x, lag(x, n)) - 1


def asof(reports: DataFrame, calendar: DataFrame, assets: DataFrame, fields: Sequence[str], fill_zero: bool = False) -> DataFrame:
    """Latest known value of each field on every trading day.

    A report dated on a day without trading shows on the next trading day. No range join is needed, see densify.
    """
    filled = densify(None, calendar, assets, reports.select("tradedate", "symbol", *fields))
    return filled.fillna(0.0, list(fields)) if fill_zero else filled
