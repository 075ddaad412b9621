"""Calendars, assets, tradability, membership pools and benchmark alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import symbol_code
from ..operators.grid import by_symbol, densify, ffill, grid, lag, so_far
from ..sources.scratch import written

FOREVER = "9999-12-31"
#: Names of the pools that are kept, indices by code.
SCOPES = ("000300", "000905", "000906", "000852", "399303", "000985", "all")


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("tradedate").distinct()


def tradable_assets(panel: DataFrame, info: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Symbols with prices and basic information, without the excluded ones."""
    return panel.select("symbol").distinct().join(info, "symbol", "left_semi").filter(~F.col("symbol").isin(*excluded) if excluded else F.lit(True))


def open_ended(date: Column) -> Column:
    """A delisting date, or the last day of time where unknown or of the year 1900."""
    return F.coalesce(F.when(F.year(date) != 1900, date), F.lit(FOREVER).cast("date"))


def members(intervals: DataFrame, days: DataFrame, start: str, end: str, closed: bool) -> DataFrame:
    """(keys of intervals, tradedate) for every day in [start, end], or [start, end) if not closed.

    An interval is cut to the calendar's ends and spread to its dates, which meet the calendar in an equi-join;
    no range join is needed, and an interval gives no more rows than the calendar spans days.
    """
    keep = [c for c in intervals.columns if c not in (start, end)]
    days = days.select("tradedate").distinct()
    ends = days.agg(F.min("tradedate").alias("_first"), F.max("tradedate").alias("_last"))
    last = F.col(end) if closed else F.date_sub(F.col(end), 1)
    cut = intervals.filter(F.col(start).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    cut = cut.select(*keep, F.greatest(F.col(start), "_first").alias("_lo"), F.least(last, "_last").alias("_hi")).filter("_lo <= _hi")
    return cut.select(*keep, F.explode(F.sequence("_lo", "_hi")).alias("tradedate")).join(days, "tradedate").select(*keep, "tradedate")


def trade_calendar(panel: DataFrame, info: DataFrame, days: DataFrame, least_days: int = 120, filled: bool = False) -> DataFrame:
    """(tradedate, symbol) that can be traded.

    Listed and listed for more than least_days trading days, no ST in the name, with volume, and not at
    the daily limit (19.5 % on board 4, 9.5 % elsewhere). filled carries an earlier 1 over blocked days.
    """
    listed = info.select("symbol", "sesname", "board", F.col("listdate").alias("lo"), open_ended(F.col("delistdate")).alias("hi"))
    cells = densify(panel.select("tradedate", "symbol", "close", "volume"), days, info).join(listed, "symbol")
    is_listed = F.coalesce(F.col("tradedate").between(F.col("lo"), F.col("hi")), F.lit(False))
    age = F.sum(is_listed.cast("int")).over(so_far())
    pct = F.try_divide(F.col("close"), lag(F.col("close"), 1)) - 1
    limit = F.when(F.col("board") == "4", 0.195).otherwise(0.095)
    ok = is_listed & (age > least_days) & ~F.contains("sesname", F.lit("ST")) & F.col("volume").isNotNull() & ~F.coalesce(pct > limit, F.lit(False))
    mark = F.when(ok, 1)
    mark = F.last(mark, ignorenulls=True).over(so_far()) if filled else mark
    return cells.withColumn("mark", mark).filter("mark = 1").select("tradedate", "symbol")


def stock_pool(membership: DataFrame, days: DataFrame, tradable: DataFrame | None = None) -> DataFrame:
    """(tradedate, symbol) of an index's members, selecteddate <= day < outdate, that can be traded."""
    spans = membership.select(F.col("selectedsymbol").alias("symbol"), "selecteddate", open_ended(F.col("outdate")).alias("outdate"))
    pool = members(spans, days, "selecteddate", "outdate", closed=False).distinct()
    return pool.join(tradable, ["tradedate", "symbol"], "left_semi") if tradable is not None else pool


def scope_pool(scope: str, tradable: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(tradedate, symbol) of a named pool: "all" is what can be traded, another name the members of that index.

    membership: symbol (the index), selectedsymbol, selecteddate, outdate; members without an entry date, or with one
    of the year 1900, are not in the pool, and an unknown or 1900 exit is open. Cells meet their own stock's spans.
    """
    cells = tradable.select("tradedate", "symbol").distinct()
    if scope == "all":
        return cells
    mine = membership.filter((F.col("symbol") == scope) & (F.year("selecteddate") != 1900))
    spans = mine.select(F.col("selectedsymbol").alias("_member"), F.col("selecteddate").alias("_lo"), open_ended(F.col("outdate")).alias("_hi"))
    inside = (F.col("symbol") == F.col("_member")) & (F.col("tradedate") >= F.col("_lo")) & (F.col("tradedate") < F.col("_hi"))
    return cells.join(spans, inside, "left_semi")


def basic_info(info: DataFrame, order: str, estclass: str | None = None) -> DataFrame:
    """One row a symbol, the first by `order`, codes padded to six digits; of one class of indices where given."""
    info = info if estclass is None else info.filter(F.col("estclass") == estclass)
    info = info.withColumn("symbol", symbol_code(F.col("symbol")))
    w = W.partitionBy("symbol").orderBy(order)
    return info.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def industries(assets: DataFrame, components: DataFrame, end: str, levels: dict[str, str]) -> DataFrame:
    """symbol and one column a level: the industry index whose component the asset is after `end`, or "0".

    components: estclass, symbol (the industry), selectedsymbol, outdate, usestatus; levels names the class of each
    column. Of several valid industries of a class the greatest code counts.
    """
    valid = components.filter((F.col("usestatus") == "1") & (open_ended(F.col("outdate")) > F.lit(end).cast("date")))
    cells = [F.max(F.when(F.col("estclass") == c, F.col("symbol"))).alias(level) for level, c in levels.items()]
    found = valid.groupBy(F.col("selectedsymbol").alias("_member")).agg(*cells)
    joined = assets.select("symbol").distinct().join(found, F.col("symbol") == F.col("_member"), "left")
    return joined.select("symbol", *[F.coalesce(level, F.lit("0")).alias(level) for level in levels])


def current_components(membership: DataFrame, on: str) -> DataFrame:
    """Index -> components list on a day (both ends count)."""
    day = F.lit(on).cast("date")
    now = membership.filter((F.col("selecteddate") <= day) & (open_ended(F.col("outdate")) >= day))
    return now.groupBy("symbol").agg(F.sort_array(F.collect_set("selectedsymbol")).alias("components"))


def benchmark_returns(close: DataFrame, days: DataFrame) -> DataFrame:
    """tradedate, close and log return of one series laid on the calendar."""
    on_days = days.select("tradedate").distinct().join(close.select("tradedate", "close"), "tradedate", "left")
    order = W.orderBy("tradedate")
    return on_days.withColumn("ret", F.ln("close") - F.lag(F.ln("close"), 1).over(order))


def period(date: Column, freq: str) -> Column:
    """Calendar end of the month or week, or the day."""
    if freq == "M":
        return F.last_day(date)
    return F.date_add(F.date_trunc("week", date).cast("date"), 6) if freq == "W" else date


def resample_last(panel: DataFrame, fields: list[str], freq: str = "M") -> DataFrame:
    """Last known value of each field in the period, at the period's end."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("tradedate"))).alias(f) for f in fields]
    return panel.withColumn("tradedate", F.col("tradedate")).groupBy("symbol", period(F.col("tradedate"), freq).alias("period")).agg(*last).withColumnRenamed("period", "tradedate")


def align_panel(panel: DataFrame, factor: str, price: str, pool: DataFrame | None = None, freq: str = "M") -> DataFrame:
    """tradedate, symbol, factor and fwd (return to the next period) on the periods that have factors.

    panel is (tradedate, symbol, factor, price); both are resampled by one group. The pool masks the factor before.
    Symbols keep the periods without values, so a return spans exactly one period. The values by period are few
    and are read several times, so they are written to the shared folder first.
    """
    cells = panel.select("tradedate", "symbol", F.col(factor).alias("factor"), F.col(price).alias("price"))
    if pool is not None:
        marked = pool.select("tradedate", "symbol").distinct().withColumn("_in", F.lit(True))
        cells = cells.join(marked, ["tradedate", "symbol"], "left").withColumn("factor", F.when(F.col("_in"), F.col("factor"))).drop("_in")
    ends = written(resample_last(cells, ["factor", "price"], freq))
    known = ends.filter("factor is not null")
    full = grid(known, known).join(ends, ["tradedate", "symbol"], "left").withColumn("price", ffill(F.col("price")))
    return full.select("tradedate", "symbol", "factor", (F.try_divide(F.lead("price").over(by_symbol()), F.col("price")) - 1).alias("fwd"))


def align_forward_returns(factor: DataFrame, price: DataFrame, pool: DataFrame | None, freq: str = "M") -> DataFrame:
    """align_panel of a factor and a price that are tables of their own, (tradedate, symbol, value) each."""
    f, p = (x.select("tradedate", "symbol", F.col("value").alias(c)) for x, c in ((factor, "factor"), (price, "price")))
    # Put together and grouped rather than joined; only symbols with a price count.
    both = f.unionByName(p, allowMissingColumns=True).groupBy("tradedate", "symbol").agg(F.max("factor").alias("factor"), F.max("price").alias("price"))
    return align_panel(both.join(p.select("symbol").distinct(), "symbol", "left_semi"), "factor", "price", pool, freq)
