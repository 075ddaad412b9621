"""Stock factors: functions of a dense panel (tradedate, symbol, fields) that add columns.

Prices are filled before use; financial fields are as-of values on the grid, 0 before the first report.
Market values and forecasts are in units of 10,000, statements in units of one. "Standard" factors are
winsorized and normalized within the date. Where two readings of a definition were possible, the
documented intent is built: newest observations weigh most in BETA, STOQ and STOA average over all their
blocks, equity is in the same unit everywhere, the eighth F-score signal is a rise of asset turnover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite, nonzero, ratio, zero_if_null
from ..operators import moving, panel, series
from ..operators.grid import backwards, bfill, by_date, ffill, lag, so_far

Step = Callable[[DataFrame], DataFrame]
STOCK_FACTORS: dict[str, Step] = {}


def factor(fn: Step) -> Step:
    """Register a step that adds a column of its own name."""
    STOCK_FACTORS[fn.__name__] = fn
    return fn


def positive(c: str) -> Column:
    """0 to NULL, then filled forward."""
    return ffill(nonzero(F.col(c)))


def standard(df: DataFrame, name: str, x: Column) -> DataFrame:
    return panel.with_standard(df.withColumn(name, x), name)


def need(df: DataFrame, *steps: Step) -> DataFrame:
    """Run the steps whose columns are not there yet, so shared parts are made once."""
    for step in steps:
        if step.__name__ not in df.columns:
            df = step(df)
    return df


def mixed(df: DataFrame, name: str, parts: dict[str, float]) -> DataFrame:
    total = F.lit(0.0)
    for c, weight in parts.items():
        total = total + weight * F.col(c)
    return df.withColumn(name, total)


# --- size and risk ----------------------------------------------------------------------------


@factor
def lncap(df: DataFrame) -> DataFrame:
    return df.withColumn("lncap", F.ln(positive("negotiablemv")))


@factor
def size(df: DataFrame) -> DataFrame:
    return standard(df, "size", F.ln(positive("negotiablemv")))


def _excess(df: DataFrame) -> DataFrame:
    return df if "excess" in df.columns else df.withColumn("excess", F.col("ret") - F.col("bm_ret"))


def _regression_sums(half_life: float) -> list[moving.Sums]:
    """What `_fitted` reads: decayed sums of the excess and the benchmark return, and plain ones."""
    known = F.col("excess").isNotNull() & F.col("bm_ret").isNotNull()
    y, x, one = F.when(known, F.col("excess")), F.when(known, F.col("bm_ret")), F.when(known, F.lit(1.0))
    decayed = moving.Sums({"_sw": one, "_sx": x, "_sy": y, "_sxx": x * x, "_sxy": x * y}, "i", half_life)
    return [decayed, moving.Sums({"_un": one, "_ux": x, "_uy": y, "_uxx": x * x, "_uxy": x * y, "_uyy": y * y})]


def _fitted(df: DataFrame, n: int) -> DataFrame:
    sw, sx, sy, sxx, sxy = (F.col(c) for c in ("_sw", "_sx", "_sy", "_sxx", "_sxy"))
    slope = F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx)
    df = df.withColumn("beta_raw", F.when(F.col("_un") >= n, slope))
    b = F.col("beta_raw")

    def mean(c: str) -> Column:
        return F.try_divide(F.col(c), F.col("_un"))

    var_x, var_y = mean("_uxx") - mean("_ux") * mean("_ux"), mean("_uyy") - mean("_uy") * mean("_uy")
    cov = mean("_uxy") - mean("_ux") * mean("_uy")
    df = df.withColumns({"halpha": F.try_divide(sy - b * sx, sw), "hsigma": F.sqrt(F.abs(var_y + b * b * var_x - 2 * b * cov))})
    return df.drop("_sw", "_sx", "_sy", "_sxx", "_sxy", "_un", "_ux", "_uy", "_uxx", "_uxy", "_uyy")


def _regression(df: DataFrame, n: int = 252, half_life: float = 63.0) -> DataFrame:
    """beta_raw, halpha and hsigma: decay-weighted regression of the excess on the benchmark return.

    hsigma is the population deviation of the frame's residuals, which are not weighted. All come from
    moving sums, so a row costs the same whatever n is.
    """
    if "beta_raw" in df.columns:
        return df
    return _fitted(moving.frame_sums(_excess(df), n, *_regression_sums(half_life)), n)


@factor
def beta(df: DataFrame) -> DataFrame:
    df = _regression(df)
    return standard(df, "beta", F.col("beta_raw"))


@factor
def halpha(df: DataFrame) -> DataFrame:
    return _regression(df)


@factor
def hsigma(df: DataFrame) -> DataFrame:
    return _regression(df)


@factor
def rstr(df: DataFrame, n: int = 504, lagged: int = 21, half_life: float = 126.0, least: int = 252) -> DataFrame:
    """Decayed sum of excess log returns that ended `lagged` rows ago."""
    df = moving.decay(_excess(df), "_d", F.col("excess"), n, half_life, "sum", least)
    return df.withColumn("rstr", lag(F.col("_d"), lagged)).drop("_d")


@factor
def momentum(df: DataFrame) -> DataFrame:
    return standard(need(df, rstr), "momentum", F.col("rstr"))


@factor
def dastd(df: DataFrame, n: int = 252, half_life: float = 42.0, least: int = 120) -> DataFrame:
    return moving.decay(_excess(df), "dastd", F.col("excess"), n, half_life, "std", least)


@factor
def cmra(df: DataFrame, months: int = 12) -> DataFrame:
    """ln(1 + highest) - ln(1 + lowest) of the 21-day excess log return over the last months; unknown returns are 0.

    The return of a month is the difference of two values of one running sum.
    """
    df = _excess(df)
    df = df.withColumns({"_sum": F.sum(zero_if_null(F.col("excess"))).over(so_far()), "_rows": F.count(F.lit(1)).over(so_far())})
    df = df.withColumns({f"_s{j}": lag(F.col("_sum"), 21 * j) for j in range(1, months + 1)})
    at = [F.col("_sum"), *[zero_if_null(F.col(f"_s{j}")) for j in range(1, months + 1)]]
    returns = [now - before for now, before in zip(at, at[1:], strict=False)]
    high, low = (F.greatest(*returns), F.least(*returns)) if months > 1 else (returns[0], returns[0])
    known = (F.col("_rows") >= 21 * months) & (high > -1) & (low > -1)
    return df.withColumn("cmra", F.when(known, F.ln(1 + high) - F.ln(1 + low))).drop("_sum", "_rows", *[f"_s{j}" for j in range(1, months + 1)])


def _risks(df: DataFrame) -> DataFrame:
    """dastd, cmra and hsigma; the frames of the first and the last are of one length and are summed at once."""
    if {"dastd", "hsigma", "beta_raw"} & set(df.columns):
        return need(df, dastd, cmra, hsigma)
    df = _excess(df).withColumn("_known", F.count("excess").over(so_far()))
    df = need(df, cmra)
    df = moving.frame_sums(df, 252, *_regression_sums(63.0), *moving.decay_sums(F.col("excess"), "_known", 42.0, "std"))
    return _fitted(df, 252).withColumn("dastd", moving.decayed(120, "std")).drop("_known", "_n", "_s", "_ss")


@factor
def residual_volatility(df: DataFrame) -> DataFrame:
    df = mixed(_risks(df), "_rv", {"dastd": 0.74, "cmra": 0.16, "hsigma": 0.10})
    return standard(df, "residual_volatility", F.col("_rv")).drop("_rv")


@factor
def nonlinear_size(df: DataFrame) -> DataFrame:
    """Residual of -size^2 on size among the pool, both held to three deviations of the symbol's own history.

    Deviations are of the population; cells outside the pool count as an average size of 0 in the regression.
    """
    own = W.partitionBy("symbol")

    def held(c: str) -> Column:
        m, sd = F.avg(c).over(own), F.stddev_pop(c).over(own)
        return clip(F.col(c), m - 3 * sd, m + 3 * sd)

    def normal(c: str) -> Column:
        return F.try_divide(F.col(c) - F.avg(c).over(by_date()), F.stddev_pop(c).over(by_date()))

    df = need(df, size).withColumn("_s", F.when(F.col("pool") == 1, F.col("size")))
    df = df.withColumn("_s", held("_s")).withColumn("_s", zero_if_null(normal("_s")))
    df = df.withColumn("_r", finite(panel.orthogonalize(-F.col("_s") * F.col("_s"), F.col("_s"))))
    df = df.withColumn("_r", held("_r")).withColumn("_r", normal("_r"))
    return standard(df, "nonlinear_size", F.col("_r")).drop("_s", "_r")


# --- value and liquidity ------------------------------------------------------------------------


def net_asset() -> Column:
    """Equity of the parent's shareholders without preferred shares and perpetual bonds."""
    return F.col("paresharrigh") - zero_if_null(F.col("prest")) - zero_if_null(F.col("perbond"))


def market_value() -> Column:
    return ffill(F.col("totmktcap")) * 1e4


@factor
def btop(df: DataFrame) -> DataFrame:
    return df.withColumn("btop", ratio(net_asset(), market_value()))


@factor
def valuation(df: DataFrame) -> DataFrame:
    return standard(need(df, btop), "valuation", F.col("btop"))


@factor
def stom(df: DataFrame) -> DataFrame:
    df = df.withColumn("_t", positive("turnrate"))
    return df.withColumn("stom", F.ln(series.ts_sum(F.col("_t"), 21))).drop("_t")


def _averaged_turnover(df: DataFrame, name: str, months: int) -> DataFrame:
    df = need(df, stom).withColumn("_e", F.exp("stom"))
    total = F.lit(0.0)
    for i in range(months):
        total = total + lag(F.col("_e"), 21 * i)
    return df.withColumn(name, F.ln(total / months)).drop("_e")


@factor
def stoq(df: DataFrame) -> DataFrame:
    return _averaged_turnover(df, "stoq", 3)


@factor
def stoa(df: DataFrame) -> DataFrame:
    return _averaged_turnover(df, "stoa", 12)


@factor
def liquidity(df: DataFrame) -> DataFrame:
    df = mixed(need(df, stom, stoq, stoa, size), "_l", {"stom": 0.35, "stoq": 0.35, "stoa": 0.30})
    df = df.withColumn("_l", panel.orthogonalize(F.col("_l"), F.col("size")))
    return standard(df, "liquidity", F.col("_l")).drop("_l")


@factor
def epfwd(df: DataFrame) -> DataFrame:
    return df.withColumn("epfwd", ratio(F.lit(1.0), F.col("pe_fcst")))


@factor
def ep(df: DataFrame) -> DataFrame:
    return df.withColumn("ep", ratio(F.col("parenetp_ttm"), market_value()))


@factor
def cp(df: DataFrame) -> DataFrame:
    return df.withColumn("cp", ratio(F.col("mananetr_ttm"), market_value()))


@factor
def earnings(df: DataFrame) -> DataFrame:
    df = mixed(need(df, epfwd, cp, ep), "_e", {"epfwd": 0.68, "cp": 0.21, "ep": 0.11})
    return standard(df, "earnings", F.col("_e")).drop("_e")


@factor
def dividend_yield(df: DataFrame) -> DataFrame:
    return standard(df, "dividend_yield", ffill(F.col("dy")))


# --- growth -------------------------------------------------------------------------------------


#: Growth factors and the fields they are of.
GROWN = {"egrow": "bizinco_ttm", "npgrow": "parenetp_ttm"}


def growth_of(df: DataFrame, **fields: str) -> DataFrame:
    """Slope over mean of per-share values at 0, 1 and 2 years ago (504, 252 and 0 rows), a column of each name.

    Unknown and zero values take the next known one, which looks ahead in time. Years ago are rows ahead in the
    order of these fills, so all fields share one sort.
    """
    df = df.withColumns({f"_v_{n}": bfill(nonzero(ratio(F.col(c), F.col("stk_share")))) for n, c in fields.items()})

    def slope(v: str) -> Column:
        now, year, two = F.col(v), F.lead(v, 252).over(backwards()), F.lead(v, 504).over(backwards())
        return ratio((now - two) / 2, (now + year + two) / 3)

    return df.withColumns({n: slope(f"_v_{n}") for n in fields}).drop(*[f"_v_{n}" for n in fields])


def _grown(df: DataFrame, name: str) -> DataFrame:
    """A growth factor, with the others whose fields are there."""
    return growth_of(df, **{n: c for n, c in GROWN.items() if n == name or (c in df.columns and n not in df.columns)})


@factor
def egrow(df: DataFrame) -> DataFrame:
    return _grown(df, "egrow")


@factor
def npgrow(df: DataFrame) -> DataFrame:
    return _grown(df, "npgrow")


@factor
def egrsf(df: DataFrame) -> DataFrame:
    """Short-term growth: next year's forecast over the trailing year."""
    return df.withColumn("egrsf", ratio(F.col("net_revenue_fcst_2"), F.col("parenetp_ttm") / 1e4) - 1)


@factor
def egrlf(df: DataFrame) -> DataFrame:
    """Long-term growth: the three-year forecast over the trailing year."""
    return df.withColumn("egrlf", ratio(F.col("net_revenue_fcst"), F.col("parenetp_ttm") / 1e4) - 1)


@factor
def growth(df: DataFrame) -> DataFrame:
    df = mixed(need(df, egrlf, egrsf, npgrow, egrow), "_g", {"egrlf": 0.18, "egrsf": 0.11, "npgrow": 0.24, "egrow": 0.47})
    return standard(df, "growth", F.col("_g")).drop("_g")


# --- leverage -----------------------------------------------------------------------------------


@factor
def mlev(df: DataFrame) -> DataFrame:
    cap = ffill(F.col("totmktcap"))
    owed = (zero_if_null(F.col("prest")) + zero_if_null(F.col("totalnoncliab"))) / 1e4
    return df.withColumn("_cap", cap).withColumn("mlev", ratio(F.col("_cap") + owed, F.col("_cap"))).drop("_cap")


@factor
def blev(df: DataFrame) -> DataFrame:
    """Book equity with preferred shares and long-term debt, over book equity; only an unknown debt is unknown."""
    preferred, debt = zero_if_null(F.col("prest")) / 1e4, F.col("totalnoncliab") / 1e4
    equity = zero_if_null(F.col("righaggr")) / 1e4 - preferred
    return df.withColumn("blev", ratio(equity + preferred + debt, equity))


@factor
def dtoa(df: DataFrame) -> DataFrame:
    return df.withColumn("dtoa", ratio(zero_if_null(F.col("totliab")), zero_if_null(F.col("totasset"))))


@factor
def leverage(df: DataFrame) -> DataFrame:
    df = mixed(need(df, mlev, blev, dtoa), "_l", {"mlev": 0.5, "blev": 0.3, "dtoa": 0.2})
    return standard(df, "leverage", F.col("_l")).drop("_l")


# --- quality ------------------------------------------------------------------------------------


def four_quarters(field: str) -> Column:
    return (F.col(field) + F.col(f"{field}_1") + F.col(f"{field}_2") + F.col(f"{field}_3")) / 4


def profit_over(base: str, field: str = "parenetp", is_ttm: bool = False, is_avg: bool = True) -> Column:
    """A reported (or trailing-year) value over a balance field (or its mean of four quarters)."""
    return ratio(F.col(f"{field}_ttm" if is_ttm else field), four_quarters(base) if is_avg else F.col(base))


@factor
def roe(df: DataFrame, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    return df.withColumn("roe", profit_over("paresharrigh", is_ttm=is_ttm, is_avg=is_avg))


@factor
def roe_yoy(df: DataFrame, year: int = 252, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    df = df.withColumn("_r", profit_over("paresharrigh", is_ttm=is_ttm, is_avg=is_avg))
    return df.withColumn("roe_yoy", ratio(F.col("_r"), lag(F.col("_r"), year)) - 1).drop("_r")


@factor
def roe_yoy_real(df: DataFrame, year: int = 252, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    """Change of the log of profit over equity; equity of zero or less is unknown."""
    equity = four_quarters("paresharrigh") if is_avg else F.col("paresharrigh")
    held = F.when(equity > 0, profit_over("paresharrigh", is_ttm=is_ttm, is_avg=is_avg))
    df = df.withColumn("_r", F.when(held > 0, F.ln(held)))
    return df.withColumn("roe_yoy_real", F.col("_r") - lag(F.col("_r"), year)).drop("_r")


@factor
def roa(df: DataFrame, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    return df.withColumn("roa", profit_over("totasset", is_ttm=is_ttm, is_avg=is_avg))


@factor
def roa_yoy(df: DataFrame, year: int = 252, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    df = df.withColumn("_r", profit_over("totasset", is_ttm=is_ttm, is_avg=is_avg))
    return df.withColumn("roa_yoy", ratio(F.col("_r"), lag(F.col("_r"), year)) - 1).drop("_r")


@factor
def margin_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("margin_rate", ratio(F.col("bizinco") - F.col("bizcost"), F.col("bizinco")))


@factor
def main_margin_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("main_margin_rate", ratio(F.col("mainbizinco") - F.col("mainbizcost"), F.col("mainbizinco")))


@factor
def turnover_rate(df: DataFrame, is_ttm: bool = False, is_avg: bool = True) -> DataFrame:
    return df.withColumn("turnover_rate", profit_over("totasset", "bizinco", is_ttm, is_avg))


@factor
def debt_to_asset(df: DataFrame) -> DataFrame:
    return df.withColumn("debt_to_asset", ratio(F.col("totliab"), F.col("totasset")))


@factor
def current_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("current_ratio", ratio(F.col("totcurrasset"), F.col("totalcurrliab")))


@factor
def fscore(df: DataFrame, year: int = 252) -> DataFrame:
    """Sum of eight signals of profit, cash flow, leverage, liquidity, margin and turnover; NULL if one is."""
    df = need(df, roa, debt_to_asset, current_ratio, margin_rate, turnover_rate)
    df = df.withColumns({f"_d_{c}": F.col(c) - lag(F.col(c), year) for c in ("roa", "debt_to_asset", "current_ratio", "margin_rate", "turnover_rate")})
    signals = [
        F.col("roa") > 0, F.col("_d_roa") > 0, F.col("mananetr") > 0, F.col("parenetp") - F.col("mananetr") < 0,
        F.col("_d_debt_to_asset") < 0, F.col("_d_current_ratio") >= 0, F.col("_d_margin_rate") > 0, F.col("_d_turnover_rate") > 0,
    ]
    total = F.lit(0)
    for s in signals:
        total = total + s.cast("int")
    return df.withColumn("fscore", total.cast("double")).drop(*[c for c in df.columns if c.startswith("_d_")])


# --- research scripts ---------------------------------------------------------------------------


@factor
def bp(df: DataFrame) -> DataFrame:
    return df.withColumn("bp", ratio(nonzero(net_asset()), market_value()))


@factor
def fund_flow(df: DataFrame, n: int = 20) -> DataFrame:
    """Net large flow of n known days over its absolute sum, residual on the n-day return within the date."""
    net = F.col("linflow") - F.col("loutflow")
    df = df.withColumn("_r", ratio(F.col("px"), lag(F.col("px"), n)) - 1)
    df = moving.moving_totals(df, n, _net=net, _absolute=F.abs(net), _known=net.isNotNull().cast("double"))
    df = df.withColumn("_f", F.when(F.col("_known") >= n, ratio(F.col("_net"), F.col("_absolute"))))
    return df.withColumn("fund_flow", panel.panel_reg_residual(F.col("_f"), F.col("_r"))).drop("_f", "_r", "_net", "_absolute", "_known")


@factor
def amt2mv(df: DataFrame) -> DataFrame:
    y, x = F.ln(nonzero(F.col("amount"))), F.ln("negotiablemv")
    return df.withColumns({"_y": y, "_x": x}).withColumn("amt2mv", panel.panel_reg_residual(F.col("_y"), F.col("_x"))).drop("_x", "_y")


@factor
def tr2mv(df: DataFrame) -> DataFrame:
    y, x = F.ln(nonzero(F.col("turnrate"))), F.ln("negotiablemv")
    return df.withColumns({"_y": y, "_x": x}).withColumn("tr2mv", panel.panel_reg_residual(F.col("_y"), F.col("_x"))).drop("_x", "_y")


