"""Index factors.

`ix` is an index panel (tradedate, symbol = index) on its grid with open, high, low, close, volume, amount
already positive (0 to NULL, filled forward) and bm, the benchmark's close. `members` is (index, symbol);
`stocks` a dense stock panel. An index's members meet their stocks in one equi-join that replaces a loop
over indices, then one aggregation by (index, tradedate).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import nonzero, ratio, zero_if_null
from ..operators import moving, panel, recursive, series
from ..operators.grid import by_symbol, change, ffill, lag

LEVELS = ("open", "high", "low", "close", "volume", "amount", "negotiablemv")


def positive_levels(ix: DataFrame, fields: Sequence[str] = LEVELS) -> DataFrame:
    """IndexClose, Open, High, Low, Volume, Amount, NegotiableMv: 0 to NULL, then filled forward."""
    return ix.withColumns({c: ffill(nonzero(F.col(c))) for c in fields if c in ix.columns})


# --- levels and returns -------------------------------------------------------------------------


def period_change(n: int = 1, scale: float = 1.0) -> Column:
    """Change over n days (1, 5 and 20 in the daily, weekly and monthly factors)."""
    return change(F.col("close"), n) * scale


def excess_change(n: int = 1, scale: float = 1.0) -> Column:
    return period_change(n, scale) - change(F.col("bm"), n) * scale


def log_return(n: int = 1) -> Column:
    return F.ln("close") - lag(F.ln("close"), n)


def momentum_spread(n: int = 10, m: int = 5) -> Column:
    """Log return of n days without the last m."""
    if n < m:
        raise ValueError("n must not be less than m")
    return log_return(n) - log_return(m)


def with_rows(df: DataFrame) -> DataFrame:
    """Adds i, a symbol's row from 0, which the operators of `moving` need."""
    return df if "i" in df.columns else df.withColumn("i", F.row_number().over(by_symbol()) - 1)


def _over_frame(df: DataFrame, n: int, x: Column) -> DataFrame:
    """Adds _mean and _std of the last n values of x, NULL where one is unknown."""
    df = moving.moving_moments(with_rows(df), n, _=x)
    full = F.col("__n") >= n
    return df.withColumns({"_mean": F.when(full, F.col("__mean")), "_std": F.when(full, F.col("__std"))}).drop("__n", "__mean", "__std")


def cumulated_return(ix: DataFrame, n: int = 1, window: int = 252) -> DataFrame:
    out = _over_frame(ix.withColumn("_e", excess_change(n)), window, F.col("_e"))
    return out.withColumn("cum_return", F.col("_mean") * window).drop("_e", "_mean", "_std")


def golden_return(ix: DataFrame, n: int = 20) -> DataFrame:
    """Rank of the summed intraday returns less the rank of the summed overnight returns."""
    day, night = ratio(F.col("close"), F.col("open")) - 1, ratio(F.col("open"), lag(F.col("close"), 1)) - 1
    ix = ix.withColumns({"_d": day, "_n": night}).withColumns({"_d": series.ts_sum(F.col("_d"), n), "_n": series.ts_sum(F.col("_n"), n)})
    return ix.withColumn("golden_return", panel.average_rank(F.col("_d")) - panel.average_rank(F.col("_n"))).drop("_d", "_n")


def return_per_amount(ix: DataFrame, n: int = 252) -> DataFrame:
    """Rolling mean over deviation of the excess return per amount."""
    ix = _over_frame(ix.withColumn("_r", ratio(excess_change(1), F.col("amount"))), n, F.col("_r"))
    return ix.withColumn("return_per_amount", ratio(F.col("_mean"), F.col("_std"))).drop("_r", "_mean", "_std")


def bias(n: int = 20) -> Column:
    return ratio(F.col("close"), series.ts_mean(F.col("close"), n)) - 1


def daily_std(ix: DataFrame, n: int = 252) -> DataFrame:
    out = _over_frame(ix.withColumn("_e", excess_change(1)), n, F.col("_e"))
    return out.withColumn("daily_std", F.col("_std")).drop("_e", "_mean", "_std")


def rsi(ix: DataFrame, n: int = 120) -> DataFrame:
    return recursive.rsi(ix, "close", n, "rsi")


# --- shares and their history -------------------------------------------------------------------


def share(field: str) -> Column:
    """Part of the date's total over all indices (volume and amount ratios)."""
    return panel.share_of_date(F.col(field))


def history_rank(ix: DataFrame, c: str, name: str, n: int = 756) -> DataFrame:
    """tradedate, symbol, c and its rolling percentile rank (quantile and rank factors)."""
    return recursive.rolling_rank_pct(ix, c, n, name)


# --- members --------------------------------------------------------------------------------------


def expand(members: DataFrame, stocks: DataFrame) -> DataFrame:
    """Member rows: index, tradedate and the stocks' columns."""
    return stocks.join(members.select("index", "symbol").distinct(), "symbol")


def reduce_members(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """One row an (index, tradedate), the index as symbol."""
    return rows.groupBy("tradedate", F.col("index").alias("symbol")).agg(*[x.alias(c) for c, x in aggregates.items()])


def _share_of(condition: Column, base: Column) -> Column:
    return ratio(F.count_if(condition).cast("double"), F.count(base))


def above(x: Column, mean: Column) -> Column:
    """x > mean; a price that rests for the whole frame is not above its mean, whatever rounding says."""
    return x > mean * (1 + 1e-9)


def diffusion(members: DataFrame, stocks: DataFrame, n: int = 20, smooth: int | None = None) -> DataFrame:
    """Share of members above their n-day mean among those with a price, smoothed on demand."""
    s = stocks.withColumn("_m", series.ts_mean(F.col("px"), n))
    out = reduce_members(expand(members, s), diffusion=_share_of(above(F.col("px"), F.col("_m")), F.col("px")))
    return out.withColumn("diffusion", series.ts_mean(F.col("diffusion"), smooth)) if smooth else out


def extreme_counts(members: DataFrame, stocks: DataFrame, limit: float = 0.099) -> DataFrame:
    """Members that rose or fell by more than the limit in a day."""
    s = stocks.withColumn("_p", change(F.col("px"), 1))
    return reduce_members(expand(members, s), extreme_up=F.count_if(F.col("_p") > limit).cast("double"), extreme_down=F.count_if(F.col("_p") < -limit).cast("double"))


def hindenburg(members: DataFrame, stocks: DataFrame, n: int = 252, window: int = 756, top_traded: bool = False, least: int = 250) -> DataFrame:
    """z-score over `window` days of (new highs - new lows) / members listed for more than `least` days.

    top_traded counts only the members that make up 99 % of the date's turnover.
    """
    s = stocks.select("tradedate", "symbol", "i", "px", "amount", panel.listed_days(F.col("px")).alias("_age"))
    s = moving.moving_extremes(moving.moving_sums(s, n, _n=F.col("px").isNotNull().cast("double")), n, F.col("px"), "_lo", "_hi")
    # A high needs n rows, a low n known prices.
    s = s.withColumns({"_hi": F.when(F.col("i") >= n - 1, F.col("_hi")), "_lo": F.when(F.col("_n") >= n, F.col("_lo"))})
    if top_traded:
        s = s.withColumn("_top", panel.top_share(F.col("amount"))).filter("_top = 1")
    old = F.col("_age") > least
    up, down = F.count_if(old & (F.col("px") == F.col("_hi"))), F.count_if(old & (F.col("px") == F.col("_lo")))
    out = reduce_members(expand(members, s), _d=ratio((up - down).cast("double"), F.count_if(old)))
    out = _over_frame(out, window, F.col("_d"))
    return out.withColumn("hindenburg", ratio(F.col("_d") - F.col("_mean"), F.col("_std"))).drop("_d", "_mean", "_std")


def cross_std(members: DataFrame, stocks: DataFrame, field: str, volatility: int | None = None, smooth: int | None = None, how: str = "mean", rank: int | None = None) -> DataFrame:
    """Deviation of a field across the members: all eleven cross-deviation factors by their parameters.

    volatility takes the field's rolling deviation first; smooth is a rolling mean (or deviation, by how);
    rank is the window of a rolling percentile rank at the end.
    """
    x = F.col(field) if volatility is None else series.ts_stddev(F.col(field), volatility, volatility)
    out = reduce_members(expand(members, stocks.withColumn("_x", x)), cross_std=F.stddev_samp("_x"))
    if smooth:
        c = F.col("cross_std")
        out = out.withColumn("cross_std", series.ts_mean(c, smooth) if how == "mean" else series.ts_stddev(c, smooth, smooth))
    if not rank:
        return out
    # Rests of rounding are no order: what agrees in ten digits ranks as equal.
    c = F.col("cross_std")
    scale = F.pow(F.lit(10.0), 9 - F.floor(F.log10(c)))
    return history_rank(out.withColumn("cross_std", F.when(c > 0, F.rint(c * scale) / scale).otherwise(c)), "cross_std", "cross_std_rank", rank)


def weighted(x: Column, weight: str | None, how: str = "mean") -> Column:
    """Mean, median or weighted mean of the members; a weight counts where x is unknown too."""
    if weight is None:
        return F.median(x) if how == "median" else F.avg(x)
    w = F.col(weight)
    return ratio(zero_if_null(F.sum(w * x)), F.sum(w))


WEIGHTS = ("mean", "median", "totmktcap", "negotiablemv")
COMPARISONS = {"raw": 0, "mom": 20, "mom2": 20, "yoy": 252, "yoy2": 252, "quantile": 750}


def forecasts(members: DataFrame, stocks: DataFrame, field: str, modes: Sequence[tuple[str, str]]) -> DataFrame:
    """Members' forecast of a field and its change, cleaned: a column <weight>_<comparison> for each mode.

    A forecast holds until the next one (0 is none). Members are weighted by WEIGHTS; a comparison is raw, the change
    over a month or year (mom, yoy), the difference of that change over the same span (mom2, yoy2), or the rank in
    the last 750 days (quantile).
    """
    for weight, comparison in modes:
        if weight not in WEIGHTS or comparison not in COMPARISONS:
            raise ValueError(f"unknown mode: {weight}, {comparison}")
    weights = list(dict.fromkeys(w for w, _ in modes))
    held = stocks.withColumn("_f", ffill(nonzero(F.col(field))))
    out = reduce_members(expand(members, held), **{f"_{w}": weighted(F.col("_f"), w if w in ("totmktcap", "negotiablemv") else None, w) for w in weights})
    names = [f"{w}_{c}" for w, c in modes]
    for w, c in modes:
        n, name = COMPARISONS[c], f"{w}_{c}"
        if c == "quantile":
            ranked = history_rank(out, f"_{w}", name, n).drop(f"_{w}")
            out = out.join(ranked, ["tradedate", "symbol"])
            continue
        out = out.withColumn(name, change(F.col(f"_{w}"), n) if n else F.col(f"_{w}"))
        if c in ("mom2", "yoy2"):
            out = out.withColumn(name, F.col(name) - lag(F.col(name), n))
    return panel.with_cleaned(out.select("tradedate", "symbol", *names), *names)


def forecast(members: DataFrame, stocks: DataFrame, field: str, weight_type: str = "mean", comparison: str = "raw") -> DataFrame:
    """One mode of forecasts, as fcst."""
    return forecasts(members, stocks, field, [(weight_type, comparison)]).withColumnRenamed(f"{weight_type}_{comparison}", "fcst")


def holding_moneys(members: DataFrame, stocks: DataFrame, n: int, modes: Sequence[tuple[str, str, str]], holding: str = "shhksharehold") -> DataFrame:
    """n-day money of holding changes over n-day turnover: a column <count>_<weight>_<pool> for each mode.

    count: net or absolute change of the holding, times the price (0 where unknown). weight: raw (sums first, then
    the ratio), or the members' ratios weighted by totmktcap, negotiablemv or amount. pool: industry (all members) or
    held (members of which a holding is known at all). Sums need n rows, those of turnover n known ones.
    """
    step = F.col("px") * (F.col(holding) - lag(F.col(holding), 1))
    s = with_rows(stocks).withColumns({"_net": zero_if_null(step), "_absolute": zero_if_null(F.abs(step))})
    s = moving.moving_sums(s, n, _net_n=F.col("_net"), _absolute_n=F.col("_absolute"), _turnover=F.col("amount"), _known=F.col("amount").isNotNull().cast("double"))
    whole = F.col("i") >= n - 1
    s = s.withColumns({"_turnover": F.when(F.col("_known") >= n, F.col("_turnover")), "_held": F.max(F.col(holding).isNotNull()).over(W.partitionBy("symbol"))})
    s = s.withColumns({f"_{c}_n": F.when(whole, F.col(f"_{c}_n")) for c in ("net", "absolute")})
    made = {}
    for count, weight, pool in modes:
        mine = F.col("_held") if pool == "held" else F.lit(True)
        money = F.col(f"_{count}_n")
        if weight == "raw":
            value = ratio(zero_if_null(F.sum(F.when(mine, money))), zero_if_null(F.sum(F.when(mine, F.col("_turnover")))))
        else:
            w = F.when(mine, F.col(weight))
            value = ratio(zero_if_null(F.sum(w * ratio(money, F.col("_turnover")))), F.sum(w))
        made[f"{count}_{weight}_{pool}"] = value
    return reduce_members(expand(members, s), **made)


def holding_money(members: DataFrame, stocks: DataFrame, n: int = 20, weight: str = "totmktcap", absolute: bool = False, held_only: bool = True, holding: str = "shhksharehold") -> DataFrame:
    """One mode of holding_moneys, as holding_money."""
    mode = ("absolute" if absolute else "net", weight, "held" if held_only else "industry")
    return holding_moneys(members, stocks, n, [mode], holding).withColumnRenamed("_".join(mode), "holding_money")


def fund_flow_ratio(
    members: DataFrame, stocks: DataFrame, n: int = 20, inflow: Sequence[str] = ("inflow",), outflow: Sequence[str] = ("outflow",), count_type: int = 1, weight: str | None = None,
) -> DataFrame:
    """n-day net flow of the members over a base; a member counts where its n days are known.

    The base is the n-day sum of, by count_type, the absolute net flow (1), the amount (2), inflow plus outflow
    (3) or their absolute values (4); or, with a weight, the members' sum of it that day (totmktcap,
    negotiablemv or amount). Several inflow and outflow fields are added up.
    """

    def total(fields: Sequence[str]) -> Column:
        return reduce(lambda x, y: x + y, [F.col(c) for c in fields])

    into, out = total(inflow), total(outflow)
    below = {1: F.abs(into - out), 2: F.col("amount"), 3: into + out, 4: F.abs(into) + F.abs(out)}[count_type]
    s = stocks.withColumns({"_n": series.ts_sum(into - out, n), "_b": F.col(weight) if weight else series.ts_sum(below, n)})
    return reduce_members(expand(members, s), fund_flow_ratio=ratio(zero_if_null(F.sum("_n")), F.sum("_b")))


def small_fund_correlation(members: DataFrame, stocks: DataFrame, ix: DataFrame, n: int = 20, inflow: str = "inflow", outflow: str = "outflow") -> DataFrame:
    """Rolling Spearman of the members' summed changes of net small flow and the lagged change of the index return.

    A change is taken stock by stock where two days are known; a day without any is 0.
    """
    net = F.col(inflow) - F.col(outflow)
    flow = reduce_members(expand(members, stocks.withColumn("_c", net - lag(net, 1))), _x=zero_if_null(F.sum("_c")))
    both = ix.select("tradedate", "symbol", change(F.col("close"), 1).alias("_r")).join(flow, ["tradedate", "symbol"], "left")
    both = both.withColumn("_y", F.col("_r") - lag(F.col("_r"), 1)).withColumn("_y", lag(F.col("_y"), 1))
    return recursive.rolling_spearman(both, "_x", "_y", n, "small_fund_corr").drop("_x", "_y")


def chip_return(members: DataFrame, stocks: DataFrame, n: int = 20) -> DataFrame:
    """Mean n-day return of the members whose chips of n days ago survive.

    The weight that survives (the turnover n days ago times what was not turned over since) cancels, but a member
    counts only if n such weights are known, for n + 1 turnovers each, and one of them at least is not zero.
    """
    turned = F.col("turnrate")
    s = with_rows(stocks).withColumn("_first", lag(turned, n))
    s = moving.moving_sums(s, n, _known=turned.isNotNull().cast("double"), _all=(turned == 1).cast("double"))
    weight = F.when((F.col("_known") >= n) & F.col("_first").isNotNull(), ((F.col("_all") == 0) & (F.col("_first") != 0)).cast("double"))
    s = moving.moving_sums(s.withColumn("_w", weight), n, _ws=F.col("_w"), _wn=F.col("_w").isNotNull().cast("double"))
    s = s.withColumn("_r", F.when((F.col("_wn") >= n) & (F.col("_ws") > 0), change(F.col("px"), n)))
    return reduce_members(expand(members, s), chip_return=F.avg("_r"))


def with_strength(stocks: DataFrame, fit: str) -> DataFrame:
    """Adds strong_<fit>: 1 where the price is above its n-day mean (ma60, ma120) or that of n days ago (gt220), else 0."""
    n, px = int(fit[2:]), F.col("px")
    if fit.startswith("ma"):
        s = _over_frame(stocks, n, px)
        return s.withColumn(f"strong_{fit}", F.coalesce(above(px, F.col("_mean")), F.lit(False)).cast("double")).drop("_mean", "_std")
    return stocks.withColumn(f"strong_{fit}", F.coalesce(px > lag(px, n), F.lit(False)).cast("double"))


def strong_ratios(members: DataFrame, stocks: DataFrame, modes: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Share of strong members, a column <fit>_<weight> for each mode; a member without a price is not strong.

    Members count equally (weight None, named equal), or by totmktcap, negotiablemv or amount.
    """
    for fit in dict.fromkeys(f for f, _ in modes):
        stocks = with_strength(stocks, fit)
    return reduce_members(expand(members, stocks), **{f"{fit}_{w or 'equal'}": weighted(F.col(f"strong_{fit}"), w) for fit, w in modes})


def strong_ratio(members: DataFrame, stocks: DataFrame, fit: str = "ma60", weight: str | None = None) -> DataFrame:
    """One mode of strong_ratios, as strong_ratio."""
    return strong_ratios(members, stocks, [(fit, weight)]).withColumnRenamed(f"{fit}_{weight or 'equal'}", "strong_ratio")


def strong_short_to_long(members: DataFrame, stocks: DataFrame, fit: str = "ma60", weight: str | None = None, kind: int = 1, short: int = 5, long: int = 20) -> DataFrame:
    """Change over `short` days (1), mean of `short` over mean of `long` days (2), or the change of that over `long` days (3)."""
    out = strong_ratio(members, stocks, fit, weight)
    x = F.col("strong_ratio")
    if kind == 1:
        return out.withColumn("strong_ratio", x - lag(x, short))
    out = out.withColumn("strong_ratio", ratio(series.ts_mean(x, short), series.ts_mean(x, long)))
    return out if kind == 2 else out.withColumn("strong_ratio", x - lag(x, long))
