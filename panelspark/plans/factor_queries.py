"""Queries over stock and index factors, a family of columns each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel, recursive
from ..sources import tables
from . import index_factors as ixf
from . import labels
from . import stock_factors as sf
from .registry import ASSETS, INDEX, MARKET, MARKET_CLOSE, PANEL, over, query, rounded, sql_rank_pct, sql_rounded
from .report_queries import _TTM, FULL
from .series_queries import rsi_sql

CELLS = ["tradedate", "symbol"]
_D = "OVER (PARTITION BY tradedate)"
_S = "PARTITION BY symbol ORDER BY tradedate"

_ASOF = ("revenue", "revenue_ttm", "revenue_1", "revenue_2", "revenue_3")
#: Statement fields: 0 before the first report.
_REPORTED = {
    "bizinco_ttm": "revenue_ttm", "bizcost_ttm": "revenue_ttm * 0.6::DOUBLE + 1000", "parenetp_ttm": "revenue_ttm * 0.1::DOUBLE - 5000", "mananetr_ttm": "revenue_ttm * 0.12::DOUBLE - 6000",
    "bizinco": "revenue", "bizcost": "revenue * 0.6::DOUBLE + 1000", "mainbizinco": "revenue * 0.9::DOUBLE", "mainbizcost": "revenue * 0.5::DOUBLE + 500",
    "parenetp": "revenue * 0.1::DOUBLE - 5000", "mananetr": "revenue * 0.12::DOUBLE - 6000", "prest": "revenue * 0.01::DOUBLE", "perbond": "revenue * 0.002::DOUBLE",
    "righaggr": "revenue * 2.2::DOUBLE - 9000", "totliab": "revenue * 3 - 2000", "totalnoncliab": "revenue", "totcurrasset": "revenue * 2.5::DOUBLE", "totalcurrliab": "revenue * 1.5::DOUBLE + 100",
    **{f"paresharrigh{i}": f"revenue{i} * 2 - 10000" for i in ("", "_1", "_2", "_3")}, **{f"totasset{i}": f"revenue{i} * 5" for i in ("", "_1", "_2", "_3")},
}
STOCK = (
    MARKET
    + ","
    + MARKET_CLOSE
    + ", bm AS (SELECT tradedate, ln(close) - lag(ln(close)) OVER (ORDER BY tradedate) AS bm_ret FROM mc),"
    + FULL.replace("\nq AS", "\nrq AS").replace("FROM q\n", "FROM rq\n").replace("FROM q)", "FROM rq)").replace("revenue FROM q", "revenue FROM rq")
    + f""", tt AS (SELECT *, {_TTM} AS revenue_ttm FROM full_ WINDOW w AS (PARTITION BY symbol ORDER BY enddate)),
lg AS (SELECT symbol, enddate, publishdate, revenue, revenue_ttm, lag(revenue, 1) OVER w AS revenue_1, lag(revenue, 2) OVER w AS revenue_2, lag(revenue, 3) OVER w AS revenue_3
  FROM tt WINDOW w AS (PARTITION BY symbol ORDER BY enddate)),
pc AS (SELECT symbol, tradedate, unnest(v) FROM (SELECT symbol, publishdate AS tradedate, arg_max({{{", ".join(f"{c}: {c}" for c in _ASOF)}}}, enddate) AS v FROM lg WHERE symbol IN (SELECT symbol FROM g) GROUP BY 1, 2)),
un AS (SELECT tradedate, symbol, true AS og, {", ".join(f"NULL::DOUBLE AS {c}" for c in _ASOF)} FROM g UNION ALL SELECT tradedate, symbol, NULL, {", ".join(_ASOF)} FROM pc),
on_ AS (SELECT tradedate, symbol, max(og) AS og, {", ".join(f"max({c}) AS {c}" for c in _ASOF)} FROM un GROUP BY ALL),
fi AS (SELECT tradedate, symbol, og, {", ".join(f"last_value({c} IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS {c}" for c in _ASOF)} FROM on_),
st AS (SELECT g.*, bm_ret, {", ".join(_ASOF)}, px * 800 AS negotiablemv, px * 1000 AS totmktcap, vol / 100 AS turnrate, 1000.0::DOUBLE + i / 100.0::DOUBLE AS stk_share, close / 1e5 AS dy, px / 50 AS pe_fcst,
  revenue_ttm * 1.4e-5::DOUBLE AS net_revenue_fcst, revenue_ttm * 1.2e-5::DOUBLE - 0.3::DOUBLE AS net_revenue_fcst_2, coalesce(inflow, 0) AS linflow, coalesce(outflow, 0) AS loutflow,
  CASE WHEN px IS NOT NULL AND i >= 60 THEN 1.0::DOUBLE END AS pool, {", ".join(f"coalesce({x}, 0) AS {c}" for c, x in _REPORTED.items())}
  FROM g JOIN bm USING (tradedate) LEFT JOIN fi USING (tradedate, symbol))"""
)


def std(source: str, out: str, *columns: str) -> str:
    """CTEs that winsorize and normalize columns of a source."""
    held = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_md + 5 * {c}_mad), {c}_md - 5 * {c}_mad) END AS {c}" for c in columns)
    z = ", ".join(f"CASE WHEN stddev_samp({c}) {_D} > 0 THEN ({c} - avg({c}) {_D}) / stddev_samp({c}) {_D} END AS {c}" for c in columns)
    return f"""{out}_1 AS (SELECT *, {", ".join(f"median({c}) {_D} AS {c}_md" for c in columns)} FROM {source}),
{out}_2 AS (SELECT *, {", ".join(f"median(abs({c} - {c}_md)) {_D} AS {c}_mad" for c in columns)} FROM {out}_1),
{out}_3 AS (SELECT * REPLACE ({held}) FROM {out}_2), {out} AS (SELECT * REPLACE ({z}) FROM {out}_3)"""


#: Factors of prices, volumes and flows only: no statement is read for them.
PRICED = frozenset({
    "lncap", "size", "nonlinear_size", "beta", "hsigma", "halpha", "rstr", "momentum", "dastd", "cmra", "residual_volatility", "stom", "stoq", "stoa", "liquidity", "dividend_yield",
    "fund_flow", "amt2mv", "tr2mv",
})


def stock_query(name: str, columns: tuple[str, ...], ctes: str | None, source: str = "x", digits: int = 3, calm: bool = False) -> None:
    """A query of some factors; a calm one takes a tenth of the returns, as those of the test tables are wild."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = (tables.priced_market if PRICED.issuperset(columns) else tables.stock_market)(spark, sf_dir)
        m = m.withColumns({c: F.col(c) / 10 for c in ("ret", "bm_ret")}) if calm else m
        df = sf.need(m, *[sf.STOCK_FACTORS[c] for c in columns])
        return df.select(*CELLS, *[rounded(c, digits).alias(c) for c in columns])

    base = STOCK + (", st AS (SELECT * REPLACE (ret / 10 AS ret, bm_ret / 10 AS bm_ret) FROM wild)" if calm else "")
    base = base.replace("st AS (SELECT g.*, bm_ret", "wild AS (SELECT g.*, bm_ret") if calm else base
    sql = None if ctes is None else f"WITH {base}, {ctes} SELECT tradedate, symbol, {', '.join(f'{sql_rounded(c, digits)} AS {c}' for c in columns)} FROM {source}"
    query(sql, name)(run)


def lagged(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({_S})"


_FILLED = f"last_value(nullif({{0}}, 0) IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING)"
_LNCAP = f"ln({_FILLED.format('negotiablemv')})"
stock_query("factors_size", ("lncap", "size"), f"y AS (SELECT *, {_LNCAP} AS lncap, {_LNCAP} AS size FROM st), {std('y', 'x', 'size')}")
_OWN = "OVER (PARTITION BY symbol)"


def _held(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, avg({c}) {_OWN} + 3 * stddev_pop({c}) {_OWN}), avg({c}) {_OWN} - 3 * stddev_pop({c}) {_OWN}) END"


def _normal(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) {_D} > 0 THEN ({c} - avg({c}) {_D}) / stddev_pop({c}) {_D} END"


NONLINEAR = f"""y AS (SELECT tradedate, symbol, pool, {_LNCAP} AS size FROM st), {std("y", "z", "size")}, n0 AS (SELECT tradedate, symbol, size * pool AS s FROM z),
n1 AS (SELECT *, {_held("s")} AS s0 FROM n0), n2 AS (SELECT *, coalesce({_normal("s0")}, 0) AS s2 FROM n1),
n3 AS (SELECT *, -s2 * s2 - regr_slope(-s2 * s2, s2) {_D} * s2 - regr_intercept(-s2 * s2, s2) {_D} AS r0 FROM n2),
n4 AS (SELECT *, CASE WHEN isfinite(r0) THEN r0 END AS r1 FROM n3), n5 AS (SELECT *, {_held("r1")} AS r2 FROM n4),
n6 AS (SELECT tradedate, symbol, {_normal("r2")} AS nonlinear_size FROM n5), {std("n6", "x", "nonlinear_size")}"""
stock_query("factors_nonlinear_size", ("nonlinear_size",), NONLINEAR, digits=2)
_W = "CASE WHEN ret - bm_ret IS NOT NULL THEN pow(2.0, (i - 1250) / 63.0) END"
_O = over(252)
_REG = f"""e AS (SELECT *, ret - bm_ret AS excess, {_W} AS w, CASE WHEN ret - bm_ret IS NOT NULL THEN bm_ret END AS bx FROM st),
m AS (SELECT *, count(w) {_O} AS n, sum(w) {_O} AS sw, sum(w * bm_ret) {_O} AS sx, sum(w * excess) {_O} AS sy, sum(w * bm_ret * bm_ret) {_O} AS sxx, sum(w * bm_ret * excess) {_O} AS sxy,
  var_pop(excess) {_O} AS vy, var_pop(bx) {_O} AS vx, covar_pop(excess, bx) {_O} AS cv FROM e),
b AS (SELECT *, CASE WHEN n >= 252 THEN (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) END AS beta FROM m),
h AS (SELECT *, (sy - beta * sx) / sw AS halpha, sqrt(abs(vy + beta * beta * vx - 2 * beta * cv)) AS hsigma FROM b)"""
stock_query("factors_beta", ("beta", "hsigma"), f"{_REG}, {std('h', 'x', 'beta')}")
stock_query("factors_alpha", ("halpha",), f"{_REG}, x AS (SELECT * FROM h)", digits=5)
_K = f"k AS (SELECT *, ret - bm_ret AS excess, count(ret - bm_ret) OVER ({_S} ROWS UNBOUNDED PRECEDING)::DOUBLE AS k FROM st)"
stock_query(
    "factors_momentum", ("rstr", "momentum"),
    f"""{_K}, d AS (SELECT *, CASE WHEN count(excess) {over(504)} >= 252 THEN sum(excess * pow(2.0, k / 126.0)) {over(504)} * pow(2.0, -k / 126.0) END AS d FROM k),
l AS (SELECT *, {lagged("d", 21)} AS rstr, {lagged("d", 21)} AS momentum FROM d), {std("l", "x", "momentum")}""",
)
_ZLAGS = [f"lag(z, {21 * i}) OVER ({_S})" for i in range(12)]
_VOL = f"""{_K}, d AS (SELECT *, CASE WHEN count(excess) {over(252)} >= 120 THEN stddev_pop(excess * pow(2.0, k / 42.0)) {over(252)} * pow(2.0, -k / 42.0) END AS dastd,
  CASE WHEN count(*) {over(21)} >= 21 THEN sum(coalesce(excess, 0)) {over(21)} END AS z FROM k),
c0 AS (SELECT *, [{", ".join(_ZLAGS)}] AS zs FROM d),
c AS (SELECT *, CASE WHEN len(list_filter(zs, lambda v: v IS NULL)) = 0 AND list_max(zs) > -1 AND list_min(zs) > -1 THEN ln(1 + list_max(zs)) - ln(1 + list_min(zs)) END AS cmra FROM c0)"""
stock_query("factors_volatility", ("dastd", "cmra"), _VOL, "c", calm=True)
stock_query(
    "factors_residual_volatility", ("residual_volatility",),
    f"""{_REG}, {_VOL.replace("k AS (SELECT *, ret - bm_ret AS excess", "k AS (SELECT tradedate, symbol, ret, excess, hsigma").replace("FROM st)", "FROM h)", 1)},
rv AS (SELECT *, 0.74::DOUBLE * dastd + 0.16::DOUBLE * cmra + 0.1::DOUBLE * hsigma AS residual_volatility FROM c), {std("rv", "x", "residual_volatility")}""", calm=True,
)
_CAP = f"(last_value(totmktcap IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) * 1e4)"
_NET_ASSET = "(paresharrigh - coalesce(prest, 0) - coalesce(perbond, 0))"
stock_query("factors_value", ("btop", "valuation", "bp"), f"y AS (SELECT *, {_NET_ASSET} / {_CAP} AS btop, {_NET_ASSET} / {_CAP} AS valuation, nullif({_NET_ASSET}, 0) / {_CAP} AS bp FROM st), {std('y', 'x', 'valuation')}", digits=4)
_T0 = f"CASE WHEN count(tf) {over(21)} >= 21 THEN ln(sum(tf) {over(21)}) END"
_TURN = f"""tf AS (SELECT *, {_FILLED.format("turnrate")} AS tf FROM st), a AS (SELECT *, {_T0} AS stom, exp({_T0}) AS ex, {_LNCAP} AS size FROM tf),
q AS (SELECT *, ln((0.0::DOUBLE + {" + ".join(lagged("ex", 21 * i) for i in range(3))}) / 3) AS stoq, ln((0.0::DOUBLE + {" + ".join(lagged("ex", 21 * i) for i in range(12))}) / 12) AS stoa FROM a)"""
stock_query("factors_turnover", ("stom", "stoq", "stoa"), _TURN, "q")
stock_query(
    "factors_liquidity", ("liquidity",),
    f"""{_TURN}, {std("q", "z", "size")}, l0 AS (SELECT tradedate, symbol, size AS sz, 0.35::DOUBLE * stom + 0.35::DOUBLE * stoq + 0.30::DOUBLE * stoa AS l FROM z),
l1 AS (SELECT *, l - regr_slope(l, sz) {_D} * sz - regr_intercept(l, sz) {_D} AS v FROM l0), l2 AS (SELECT tradedate, symbol, CASE WHEN isfinite(v) THEN v END AS liquidity FROM l1), {std("l2", "x", "liquidity")}""",
)
stock_query(
    "factors_earnings", ("epfwd", "ep", "cp", "earnings"),
    f"""y AS (SELECT *, 1.0::DOUBLE / nullif(pe_fcst, 0) AS epfwd, parenetp_ttm / {_CAP} AS ep, mananetr_ttm / {_CAP} AS cp FROM st),
z AS (SELECT *, 0.68::DOUBLE * epfwd + 0.21::DOUBLE * cp + 0.11::DOUBLE * ep AS earnings FROM y), {std("z", "x", "earnings")}""",
)
stock_query("factors_dividend", ("dividend_yield",), f"y AS (SELECT tradedate, symbol, last_value(dy IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS dividend_yield FROM st), {std('y', 'x', 'dividend_yield')}")


def _grow(field: str) -> str:
    return f"first_value(nullif({field} / stk_share, 0) IGNORE NULLS) OVER ({_S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _slope(v: str) -> str:
    return f"(({v} - {lagged(v, 504)}) / 2) / nullif(({v} + {lagged(v, 252)} + {lagged(v, 504)}) / 3, 0)"


stock_query(
    "factors_growth", ("egrow", "npgrow", "egrsf", "egrlf", "growth"),
    f"""y AS (SELECT *, {_grow("bizinco_ttm")} AS v1, {_grow("parenetp_ttm")} AS v2, net_revenue_fcst_2 / nullif(parenetp_ttm / 1e4, 0) - 1 AS egrsf, net_revenue_fcst / nullif(parenetp_ttm / 1e4, 0) - 1 AS egrlf FROM st),
z AS (SELECT *, {_slope("v1")} AS egrow, {_slope("v2")} AS npgrow FROM y), z2 AS (SELECT *, 0.18::DOUBLE * egrlf + 0.11::DOUBLE * egrsf + 0.24::DOUBLE * npgrow + 0.47::DOUBLE * egrow AS growth FROM z), {std("z2", "x", "growth")}""",
)
stock_query(
    "factors_leverage", ("mlev", "blev", "dtoa", "leverage"),
    f"""y AS (SELECT *, ({_CAP} / 1e4 + coalesce(prest, 0) / 1e4 + coalesce(totalnoncliab, 0) / 1e4) / ({_CAP} / 1e4) AS mlev,
  (coalesce(righaggr, 0) / 1e4 + totalnoncliab / 1e4) / nullif(coalesce(righaggr, 0) / 1e4 - coalesce(prest, 0) / 1e4, 0) AS blev, coalesce(totliab, 0) / nullif(coalesce(totasset, 0), 0) AS dtoa FROM st),
z AS (SELECT *, 0.5::DOUBLE * mlev + 0.3::DOUBLE * blev + 0.2::DOUBLE * dtoa AS leverage FROM y), {std("z", "x", "leverage")}""",
)
_EQ4 = "((paresharrigh + paresharrigh_1 + paresharrigh_2 + paresharrigh_3) / 4)"
_AS4 = "((totasset + totasset_1 + totasset_2 + totasset_3) / 4)"
_QUALITY = f"""y AS (SELECT *, parenetp / nullif({_EQ4}, 0) AS roe, parenetp / nullif({_AS4}, 0) AS roa, (bizinco - bizcost) / nullif(bizinco, 0) AS margin_rate,
  (mainbizinco - mainbizcost) / nullif(mainbizinco, 0) AS main_margin_rate, bizinco / nullif({_AS4}, 0) AS turnover_rate, totliab / nullif(totasset, 0) AS debt_to_asset,
  totcurrasset / nullif(totalcurrliab, 0) AS current_ratio, CASE WHEN {_EQ4} > 0 AND parenetp / {_EQ4} > 0 THEN ln(parenetp / {_EQ4}) END AS lr FROM st),
x AS (SELECT *, roe / nullif({lagged("roe", 252)}, 0) - 1 AS roe_yoy, roa / nullif({lagged("roa", 252)}, 0) - 1 AS roa_yoy, lr - {lagged("lr", 252)} AS roe_yoy_real FROM y)"""
stock_query("factors_quality", ("roe", "roe_yoy", "roe_yoy_real", "roa", "roa_yoy", "margin_rate", "main_margin_rate", "turnover_rate", "debt_to_asset", "current_ratio"), _QUALITY)


def _quality_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return on equity and assets and asset turnover with the switches away from their defaults."""
    m = tables.stock_market(spark, sf_dir)
    m = m.transform(sf.roe, True, False).transform(sf.roa, True, True).transform(sf.turnover_rate, True, False).transform(sf.roe_yoy_real, 120, True, False)
    return m.select(*CELLS, *[rounded(c).alias(c) for c in ("roe", "roa", "turnover_rate", "roe_yoy_real")])


query(
    f"""WITH {STOCK}, y AS (SELECT *, CASE WHEN paresharrigh > 0 AND parenetp_ttm / paresharrigh > 0 THEN ln(parenetp_ttm / paresharrigh) END AS lr FROM st),
z AS (SELECT *, lr - {lagged("lr", 120)} AS yoy, parenetp_ttm / nullif(paresharrigh, 0) AS e, parenetp_ttm / nullif({_AS4}, 0) AS a, bizinco_ttm / nullif(totasset, 0) AS t FROM y)
SELECT tradedate, symbol, {sql_rounded("e")} AS roe, {sql_rounded("a")} AS roa, {sql_rounded("t")} AS turnover_rate, {sql_rounded("yoy")} AS roe_yoy_real FROM z""",
    "factors_quality_ttm",
)(_quality_modes)


def _up(c: str, sign: str = ">") -> str:
    return f"({c} - {lagged(c, 252)} {sign} 0)::INT"


stock_query(
    "factors_fscore", ("fscore",),
    _QUALITY + f""", f AS (SELECT tradedate, symbol, ((roa > 0)::INT + {_up("roa")} + (mananetr > 0)::INT + (parenetp - mananetr < 0)::INT + {_up("debt_to_asset", "<")}
  + {_up("current_ratio", ">=")} + {_up("margin_rate")} + {_up("turnover_rate")})::DOUBLE AS fscore FROM x)""", "f",
)
_RES = "CASE WHEN y IS NOT NULL AND x IS NOT NULL AND count(y + x) {d} >= 0.05 * count(*) {d} THEN y - regr_slope(y, x) {d} * x - regr_intercept(y, x) {d} END".format(d=_D)
stock_query(
    "fund_flow_residual", ("fund_flow",),
    f"""n AS (SELECT *, linflow - loutflow AS net FROM st), y AS (SELECT tradedate, symbol, CASE WHEN count(net) {over(20)} >= 20 THEN sum(net) {over(20)} / nullif(sum(abs(net)) {over(20)}, 0) END AS y,
  px / {lagged("px", 20)} - 1 AS x FROM n), x AS (SELECT tradedate, symbol, {_RES} AS fund_flow FROM y)""",
)
stock_query("factors_amount_to_value", ("amt2mv",), f"y AS (SELECT tradedate, symbol, ln(nullif(amount, 0)) AS y, ln(negotiablemv) AS x FROM st), x AS (SELECT tradedate, symbol, {_RES} AS amt2mv FROM y)")
stock_query("factors_turnover_to_value", ("tr2mv",), f"y AS (SELECT tradedate, symbol, ln(nullif(turnrate, 0)) AS y, ln(negotiablemv) AS x FROM st), x AS (SELECT tradedate, symbol, {_RES} AS tr2mv FROM y)")


#: Stocks of knowledge and organisation: 0.7^m (start + sum of 0.7^-j times the flow of the j-th change).
_INTANGIBLE = f"""e AS (SELECT tradedate, symbol, {_NET_ASSET} AS net_asset, {_CAP} AS cap, coalesce(revenue, 0) AS v, coalesce(revenue_1, 0) AS before, revenue IS NOT NULL AS started, row_number() OVER ({_S}) AS n FROM st),
s0 AS (SELECT *, CASE WHEN started AND min(CASE WHEN started THEN n END) OVER (PARTITION BY symbol) < n AND v <> {lagged("v", 1)} THEN 1 ELSE 0 END AS moved, arg_min(v, CASE WHEN started THEN n END) OVER (PARTITION BY symbol) AS v0 FROM e),
s1 AS (SELECT *, sum(moved) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS m, v + CASE WHEN month(tradedate) = 4 THEN before ELSE 0 END AS flow FROM s0),
s2 AS (SELECT *, pow(0.7::DOUBLE, m) * (v0 / 0.5::DOUBLE + sum(CASE WHEN moved = 1 THEN flow * pow(0.7::DOUBLE, -m) ELSE 0 END) OVER ({_S} ROWS UNBOUNDED PRECEDING)) AS stock FROM s1),
x AS (SELECT tradedate, symbol, net_asset, cap, CASE WHEN started THEN (0.05::DOUBLE + 0.3::DOUBLE * 0.18::DOUBLE) * stock ELSE 0 END AS intangible FROM s2)"""


@query(f"WITH {STOCK}, {_INTANGIBLE} SELECT tradedate, symbol, {sql_rounded('intangible', 2)} AS intangible, {sql_rounded('nullif(net_asset + intangible, 0) / cap')} AS bp_int FROM x")
def intangible_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net assets with intangible assets over market value; expenses are shares of the quarter's revenue."""
    m = tables.stock_market(spark, sf_dir)
    shares = {"rd": 0.05, "sales": 0.1, "manage": 0.08, "goodwill": 0.0}
    cols = {c: F.col("revenue") * s for c, s in shares.items()} | {f"{c}_1": F.col("revenue_1") * s for c, s in shares.items()}
    cols["goodwill"], cols["goodwill_1"] = F.coalesce(F.col("revenue") * 0 + 100, F.lit(0.0)), F.lit(0.0)
    m = m.select(*CELLS, sf.net_asset().alias("net_asset"), sf.market_value().alias("cap"), *[x.alias(c) for c, x in cols.items()])
    out = recursive.intangible_assets(m, "rd", "sales", "manage", "goodwill")
    bp = sf.ratio(sf.nonzero(F.col("net_asset") + F.col("intangible")), F.col("cap"))
    return out.select(*CELLS, rounded("intangible", 2).alias("intangible"), rounded(bp).alias("bp_int"))


def _cleaned(c: str, source: str, out: str) -> str:
    """CTEs that clean a column: 0 to NULL, clipped to the global quartiles, z-score of the date."""
    return f"""{out}_0 AS (SELECT tradedate, symbol, nullif({c}, 0) AS v FROM {source}), {out}_q AS (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM {out}_0),
{out}_1 AS (SELECT tradedate, symbol, CASE WHEN v IS NOT NULL THEN greatest(least(v, hi + 1.5 * (hi - lo)), lo - 1.5 * (hi - lo)) END AS v FROM {out}_0, {out}_q),
{out}_2 AS (SELECT tradedate, symbol, CASE WHEN stddev_pop(v) {_D} > 0 THEN round((v - avg(v) {_D}) / stddev_pop(v) {_D}, 9) END AS v FROM {out}_1),
{out} AS (SELECT tradedate, symbol, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY v IS NULL, v) + (count(*) OVER (PARTITION BY tradedate, v) - 1) / 2.0 END AS r FROM {out}_2)"""


@query(
    f"""WITH {STOCK}, {_INTANGIBLE.replace("x AS (SELECT tradedate, symbol, net_asset", "bi AS (SELECT tradedate, symbol, net_asset")}, b AS (SELECT tradedate, symbol, nullif(net_asset + intangible, 0) / cap AS bp_int FROM bi),
fn AS (SELECT *, linflow - loutflow AS net FROM st), fy AS (SELECT tradedate, symbol, CASE WHEN count(net) {over(20)} >= 20 THEN sum(net) {over(20)} / nullif(sum(abs(net)) {over(20)}, 0) END AS y, px / {lagged("px", 20)} - 1 AS x FROM fn),
f AS (SELECT tradedate, symbol, {_RES} AS fund_flow FROM fy), ty AS (SELECT tradedate, symbol, ln(nullif(turnrate, 0)) AS y, ln(negotiablemv) AS x FROM st), t AS (SELECT tradedate, symbol, {_RES} AS tr2mv FROM ty),
{_cleaned("bp_int", "b", "cb")}, {_cleaned("fund_flow", "f", "cf")}, {_cleaned("tr2mv", "t", "ct")},
s AS (SELECT cb.tradedate, cb.symbol, cb.r + cf.r - ct.r AS s FROM cb JOIN cf USING (tradedate, symbol) JOIN ct USING (tradedate, symbol))
SELECT tradedate, symbol, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY s IS NULL, s) + (count(*) OVER (PARTITION BY tradedate, s) - 1) / 2.0 END AS value FROM s"""
)
def naive_multi_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of cleaned book-to-price with intangibles and large flow, less that of turnover, ranked again.

    Values that agree in nine digits rank as equal.
    """
    m = tables.stock_market(spark, sf_dir)
    shares = {"rd": 0.05, "sales": 0.1, "manage": 0.08}
    cols = {c: F.col("revenue") * s for c, s in shares.items()} | {f"{c}_1": F.col("revenue_1") * s for c, s in shares.items()}
    cols |= {"goodwill": F.coalesce(F.col("revenue") * 0 + 100, F.lit(0.0)), "goodwill_1": F.lit(0.0), "net_asset": sf.net_asset(), "cap": sf.market_value()}
    m = m.select(*CELLS, "i", "px", "linflow", "loutflow", "turnrate", "negotiablemv", *[x.alias(c) for c, x in cols.items()])
    m = recursive.intangible_assets(m, "rd", "sales", "manage", "goodwill")
    m = m.withColumn("bp_int", sf.ratio(sf.nonzero(F.col("net_asset") + F.col("intangible")), F.col("cap")))
    m = sf.tr2mv(sf.fund_flow(m)).select(*CELLS, "bp_int", "fund_flow", "tr2mv")
    signs = {"bp_int": 1, "fund_flow": 1, "tr2mv": -1}
    m = panel.with_cleaned(m, *signs).withColumns({c: F.round(c, 9) for c in signs})
    return labels.multi_factor(m, signs).select(*CELLS, "value")


# --- index factors --------------------------------------------------------------------------------

IX = INDEX + "," + MARKET_CLOSE + ", ix AS (SELECT ig.*, mc.close AS bm FROM ig JOIN mc USING (tradedate))"
#: Index members with the stock market's columns, for factors that reduce members.
MEMBERS = MARKET + "," + ASSETS


def index_query(name: str, columns: tuple[str, ...], make: Callable[[DataFrame], DataFrame], ctes: str | None, source: str = "x", digits: int = 4) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(tables.index_market(spark, sf_dir)).select(*CELLS, *[rounded(c, digits).alias(c) for c in columns])

    sql = None if ctes is None else f"WITH {IX}, {ctes} SELECT tradedate, symbol, {', '.join(f'{sql_rounded(c, digits)} AS {c}' for c in columns)} FROM {source}"
    query(sql, name)(run)


def member_query(name: str, columns: tuple[str, ...], make: Callable[[DataFrame, DataFrame], DataFrame], ctes: str | None, source: str = "x", digits: int = 4, wide: bool = False) -> None:
    """A query over index members; wide ones need the market values and flows of the stock market."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        members = tables.assets(spark, sf_dir).select("index", "symbol")
        return make(members, (tables.priced_market if wide else tables.market)(spark, sf_dir)).select(*CELLS, *[rounded(c, digits).alias(c) for c in columns])

    sql = None if ctes is None else f"WITH {STOCK}, {ASSETS}, {ctes} SELECT tradedate, symbol, {', '.join(f'{sql_rounded(c, digits)} AS {c}' for c in columns)} FROM {source}"
    query(sql, name)(run)


_CH = {n: f"close / {lagged('close', n)} - 1" for n in (1, 5, 20)}
_BM = {n: f"bm / {lagged('bm', n)} - 1" for n in (1, 5, 20)}
index_query("index_levels", ("open", "high", "low", "close", "volume", "amount"), lambda ix: ix, "x AS (SELECT * FROM ix)", digits=3)
index_query(
    "index_returns", ("day", "week", "month", "pre_day", "pre_week", "pre_month", "log_20"),
    lambda ix: ix.withColumns({"day": ixf.period_change(1, 100.0), "week": ixf.period_change(5), "month": ixf.period_change(20), "pre_day": ixf.excess_change(1, 100.0),
                               "pre_week": ixf.excess_change(5), "pre_month": ixf.excess_change(20), "log_20": ixf.log_return(20)}),
    f"""x AS (SELECT tradedate, symbol, ({_CH[1]}) * 100 AS day, {_CH[5]} AS week, {_CH[20]} AS month, ({_CH[1]}) * 100 - ({_BM[1]}) * 100 AS pre_day, ({_CH[5]}) - ({_BM[5]}) AS pre_week,
  ({_CH[20]}) - ({_BM[20]}) AS pre_month, ln(close) - ln({lagged("close", 20)}) AS log_20 FROM ix)""",
)
index_query(
    "index_momentum", ("momentum_spread", "bias"), lambda ix: ix.withColumns({"momentum_spread": ixf.momentum_spread(10, 5), "bias": ixf.bias(20)}),
    f"x AS (SELECT tradedate, symbol, ln({lagged('close', 5)}) - ln({lagged('close', 10)}) AS momentum_spread, CASE WHEN count(close) {over(20)} >= 20 THEN close / avg(close) {over(20)} - 1 END AS bias FROM ix)",
)
_EX = f"e AS (SELECT *, ({_CH[1]}) - ({_BM[1]}) AS ex FROM ix)"
index_query(
    "index_cum_return", ("cum_return", "daily_std"), lambda ix: ixf.daily_std(ixf.cumulated_return(ix)),
    f"{_EX}, x AS (SELECT tradedate, symbol, CASE WHEN count(ex) {over(252)} >= 252 THEN sum(ex) {over(252)} END AS cum_return, CASE WHEN count(ex) {over(252)} >= 252 THEN stddev_samp(ex) {over(252)} END AS daily_std FROM e)",
)
index_query(
    "index_return_per_amount", ("return_per_amount",), ixf.return_per_amount,
    f"{_EX}, r AS (SELECT *, ex / amount AS r FROM e), x AS (SELECT tradedate, symbol, CASE WHEN count(r) {over(252)} >= 252 THEN avg(r) {over(252)} / stddev_samp(r) {over(252)} END AS return_per_amount FROM r)",
)
index_query(
    "index_golden_return", ("golden_return",), ixf.golden_return,
    f"""d AS (SELECT *, close / open - 1 AS d, open / {lagged("close", 1)} - 1 AS n FROM ix), s AS (SELECT *, CASE WHEN count(d) {over(20)} >= 20 THEN sum(d) {over(20)} END AS a, CASE WHEN count(n) {over(20)} >= 20 THEN sum(n) {over(20)} END AS b FROM d),
x AS (SELECT tradedate, symbol, CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY a IS NULL, a) + (count(*) OVER (PARTITION BY tradedate, a) - 1) / 2.0 END
  - CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY b IS NULL, b) + (count(*) OVER (PARTITION BY tradedate, b) - 1) / 2.0 END AS golden_return FROM s)""",
)
index_query("index_shares", ("volume_ratio", "amount_ratio"), lambda ix: ix.withColumns({"volume_ratio": ixf.share("volume"), "amount_ratio": ixf.share("amount")}), f"x AS (SELECT tradedate, symbol, volume / sum(volume) {_D} AS volume_ratio, amount / sum(amount) {_D} AS amount_ratio FROM ix)")
index_query("index_rsi", ("rsi",), ixf.rsi, f"{rsi_sql('ix', 'close', 120)}, x AS (SELECT tradedate, symbol, v AS rsi FROM rs)")
#: The reference's window of ranks and z-scores; the queries named after it run on the operators' defaults.
LONG = 756
for _n, _mark in ((250, ""), (LONG, f"_{LONG}")):
    index_query(
        f"index_volume_quantile{_mark}", ("volume_quantile",), lambda ix, n=_n: ixf.history_rank(ix, "volume", "volume_quantile", n),
        f"x AS (SELECT tradedate, symbol, {sql_rank_pct('volume', _n)} AS volume_quantile FROM ix)",
    )
    if _n == LONG:
        index_query(
            "index_amount_quantile", ("amount_quantile",), lambda ix, n=_n: ixf.history_rank(ix, "amount", "amount_quantile", n),
            f"x AS (SELECT tradedate, symbol, {sql_rank_pct('amount', _n)} AS amount_quantile FROM ix)",
        )
    for _field in ("volume", "amount"):
        index_query(
            f"index_{_field}_ratio_quantile{_mark}", (f"{_field}_ratio_quantile",), lambda ix, n=_n, c=_field: ixf.history_rank(ix.withColumn("r", ixf.share(c)), "r", f"{c}_ratio_quantile", n),
            f"y AS (SELECT *, {_field} / sum({_field}) {_D} AS r FROM ix), x AS (SELECT tradedate, symbol, {sql_rank_pct('r', _n)} AS {_field}_ratio_quantile FROM y)",
        )
_MEM = "FROM {0} JOIN assets USING (symbol) GROUP BY tradedate, index"
member_query(
    "index_diffusion", ("diffusion",), lambda m, s: ixf.diffusion(m, s, 20, 5),
    f"""a AS (SELECT *, CASE WHEN count(px) {over(20)} >= 20 THEN avg(px) {over(20)} END AS ma FROM st), r AS (SELECT tradedate, index AS symbol, (count(*) FILTER (WHERE px > ma * (1 + 1e-9::DOUBLE)))::DOUBLE / nullif(count(px), 0) AS d {_MEM.format("a")}),
x AS (SELECT tradedate, symbol, CASE WHEN count(d) {over(5)} >= 5 THEN avg(d) {over(5)} END AS diffusion FROM r)""", digits=3,
)
member_query(
    "index_extremes", ("extreme_up", "extreme_down"), ixf.extreme_counts,
    f"a AS (SELECT *, px / {lagged('px', 1)} - 1 AS p FROM st), x AS (SELECT tradedate, index AS symbol, (count(*) FILTER (WHERE p > 0.099))::DOUBLE AS extreme_up, (count(*) FILTER (WHERE p < -0.099))::DOUBLE AS extreme_down {_MEM.format('a')})",
)


def _hindenburg(top: bool, window: int = 120) -> str:
    cut = f" WHERE amount IS NOT NULL AND before < 0.99 * total" if top else ""
    return f"""a AS (SELECT *, CASE WHEN count(*) {over(252)} >= 252 THEN max(px) {over(252)} END AS hi, CASE WHEN count(px) {over(252)} >= 252 THEN min(px) {over(252)} END AS lo,
  tradedate - min(CASE WHEN px IS NOT NULL THEN tradedate END) OVER (PARTITION BY symbol) + 1 AS age, sum(amount) {_D} AS total,
  coalesce(sum(amount) OVER (PARTITION BY tradedate ORDER BY amount DESC NULLS LAST, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
k AS (SELECT * FROM a{cut}), d AS (SELECT tradedate, index AS symbol, ((count(*) FILTER (WHERE age > 250 AND px = hi)) - (count(*) FILTER (WHERE age > 250 AND px = lo)))::DOUBLE / nullif(count(*) FILTER (WHERE age > 250), 0) AS d {_MEM.format("k")}),
x AS (SELECT tradedate, symbol, CASE WHEN count(d) {over(window)} >= {window} THEN (d - avg(d) {over(window)}) / nullif(stddev_samp(d) {over(window)}, 0) END AS hindenburg FROM d)"""


member_query("index_hindenburg", ("hindenburg",), lambda m, s: ixf.hindenburg(m, s, 252, 120), _hindenburg(False), digits=3)
member_query("index_hindenburg_top", ("hindenburg",), lambda m, s: ixf.hindenburg(m, s, 252, 120, True), _hindenburg(True), digits=3)
member_query("index_hindenburg_756", ("hindenburg",), lambda m, s: ixf.hindenburg(m, s), _hindenburg(False, LONG), digits=3)
member_query("index_hindenburg_top_756", ("hindenburg",), lambda m, s: ixf.hindenburg(m, s, top_traded=True), _hindenburg(True, LONG), digits=3)


def _cross(field: str, volatility: int | None, smooth: int | None, how: str) -> str:
    x = field if volatility is None else f"CASE WHEN count({field}) {over(volatility)} >= {volatility} THEN stddev_samp({field}) {over(volatility)} END"
    out = "c" if not smooth else f"CASE WHEN count(c) {over(smooth)} >= {smooth} THEN {'avg' if how == 'mean' else 'stddev_samp'}(c) {over(smooth)} END"
    return f"a AS (SELECT *, {x} AS xx FROM st), r AS (SELECT tradedate, index AS symbol, stddev_samp(xx) AS c {_MEM.format('a')}), x AS (SELECT tradedate, symbol, {out} AS cross_std FROM r)"


for _name, _args in {
    "index_cross_volume_std": ("volume", None, 20, "mean"), "index_cross_amount_std": ("amount", None, None, "mean"), "index_cross_turnrate_std": ("turnrate", None, None, "mean"),
    "index_cross_volatility_std": ("ret", 20, 20, "mean"), "index_cross_volatility_std2": ("ret", 20, 20, "std"), "index_std_cross_turnrate_std": ("turnrate", None, 20, "mean"),
}.items():
    member_query(_name, ("cross_std",), lambda m, s, a=_args: ixf.cross_std(m, s, *a), _cross(*_args), digits=2, wide=_args[0] == "turnrate")
for _name, _args in {"index_rank_cross_volume_std": ("volume", None, 20, "mean"), "index_rank_cross_volatility_std": ("ret", 20, 20, "mean"), "index_rank_cross_amount_std": ("amount", None, None, "mean"), "index_rank_cross_turnrate_std": ("turnrate", None, None, "mean"), "index_rank_std_cross_turnrate_std": ("turnrate", None, 20, "mean")}.items():
    for _n, _mark in ((250, ""), (LONG, f"_{LONG}")):
        # As the operator, ranks what agrees in ten digits as equal.
        _sql = _cross(*_args).replace(", x AS (", ", y AS (") + ", z AS (SELECT *, pow(10.0::DOUBLE, 9 - floor(log10(nullif(cross_std, 0)))) AS scale FROM y)"
        _sql += f", v AS (SELECT tradedate, symbol, CASE WHEN cross_std > 0 THEN round(cross_std * scale) / scale ELSE cross_std END AS c FROM z), x AS (SELECT tradedate, symbol, {sql_rank_pct('c', _n)} AS cross_std_rank FROM v)"
        member_query(f"{_name}{_mark}", ("cross_std_rank",), lambda m, s, a=_args, n=_n: ixf.cross_std(m, s, *a, n), _sql, digits=3, wide=_args[0] == "turnrate")

member_query(
    "index_forecast", ("fcst",), lambda m, s: ixf.forecast(m, s, "pe_fcst", "totmktcap", "mom"),
    f"""r AS (SELECT tradedate, index AS symbol, coalesce(sum(totmktcap * pe_fcst), 0) / nullif(sum(totmktcap), 0) AS f {_MEM.format("st")}), c0 AS (SELECT tradedate, symbol, nullif(f / nullif({lagged("f", 20)}, 0) - 1, 0) AS v FROM r),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM c0), c1 AS (SELECT tradedate, symbol, CASE WHEN v IS NOT NULL THEN greatest(least(v, b + 1.5 * (b - a)), a - 1.5 * (b - a)) END AS v FROM c0, q),
x AS (SELECT tradedate, symbol, CASE WHEN stddev_pop(v) {_D} > 0 THEN (v - avg(v) {_D}) / stddev_pop(v) {_D} END AS fcst FROM c1)""", digits=3, wide=True,
)
_FCST_MODES = [(w, c) for w in ixf.WEIGHTS for c in ixf.COMPARISONS]


def _forecast_modes() -> str:
    """CTEs of every weighting and comparison: members' values, changes, then the cleaning of each column."""
    by = {"mean": "avg(f)", "median": "median(f)", **{w: f"coalesce(sum({w} * f), 0) / nullif(sum({w}), 0)" for w in ("totmktcap", "negotiablemv")}}
    moved = {"raw": "{0}", "mom": "{0} / nullif({1}, 0) - 1", "mom2": "{0} / nullif({1}, 0) - 1", "yoy": "{0} / nullif({2}, 0) - 1", "yoy2": "{0} / nullif({2}, 0) - 1"}
    first = [f"{moved[c].format(f'f_{w}', lagged(f'f_{w}', 20), lagged(f'f_{w}', 252))} AS {w}_{c}" if c in moved else f"{sql_rank_pct(f'f_{w}', 750)} AS {w}_{c}" for w, c in _FCST_MODES]
    again = [f"{w}_{c} - {lagged(f'{w}_{c}', ixf.COMPARISONS[c])} AS {w}_{c}" for w, c in _FCST_MODES if c in ("mom2", "yoy2")]
    names = [f"{w}_{c}" for w, c in _FCST_MODES]
    held = [f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, hi_{c} + 1.5 * (hi_{c} - lo_{c})), lo_{c} - 1.5 * (hi_{c} - lo_{c})) END AS {c}" for c in names]
    return f"""fs AS (SELECT *, last_value(nullif(fc, 0) IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, pe_fcst + 1 / stk_share AS fc FROM st)),
fr AS (SELECT tradedate, index AS symbol, {", ".join(f"{x} AS f_{w}" for w, x in by.items())} {_MEM.format("fs")}), f1 AS (SELECT tradedate, symbol, {", ".join(first)} FROM fr),
f2 AS (SELECT * REPLACE ({", ".join(again)}) FROM f1), f3 AS (SELECT tradedate, symbol, {", ".join(f"nullif({c}, 0) AS {c}" for c in names)} FROM f2),
fq AS MATERIALIZED (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS lo_{c}, quantile_cont({c}, 0.75) AS hi_{c}" for c in names)} FROM f3), f4 AS (SELECT tradedate, symbol, {", ".join(held)} FROM f3, fq),
x AS (SELECT tradedate, symbol, {", ".join(f"CASE WHEN stddev_pop({c}) {_D} > 0 THEN ({c} - avg({c}) {_D}) / stddev_pop({c}) {_D} END AS {c}" for c in names)} FROM f4)"""


member_query(
    "index_forecast_modes", tuple(f"{w}_{c}" for w, c in _FCST_MODES),
    lambda m, s: ixf.forecasts(m, s.withColumn("fc", F.col("pe_fcst") + 1 / F.col("stk_share")), "fc", _FCST_MODES), _forecast_modes(), digits=2, wide=True,
)
_IN, _OUT = "linflow", "loutflow"
_BASES = {1: "abs(linflow - loutflow)", 2: "coalesce(amount, 0)", 3: "linflow + loutflow", 4: "abs(linflow) + abs(loutflow)"}


def _flow(base: str) -> str:
    return f"""a AS (SELECT *, CASE WHEN count(*) {over(20)} >= 20 THEN sum(linflow - loutflow) {over(20)} END AS n, {base} AS b FROM st),
x AS (SELECT tradedate, index AS symbol, coalesce(sum(n), 0) / nullif(sum(b), 0) AS fund_flow_ratio {_MEM.format("a")})"""


def _with_amount(s: DataFrame) -> DataFrame:
    return s.withColumn("amount", F.coalesce("amount", F.lit(0.0)))


for _type, _base in _BASES.items():
    member_query(
        "index_fund_flow" if _type == 2 else f"index_fund_flow_{_type}", ("fund_flow_ratio",),
        lambda m, s, k=_type: ixf.fund_flow_ratio(m, _with_amount(s), 20, [_IN], [_OUT], k), _flow(f"CASE WHEN count(*) {over(20)} >= 20 THEN sum({_base}) {over(20)} END"), wide=True,
    )
for _weight in ("totmktcap", "negotiablemv", "amount"):
    member_query(f"index_fund_flow_{_weight}", ("fund_flow_ratio",), lambda m, s, w=_weight: ixf.fund_flow_ratio(m, s, 20, [_IN], [_OUT], weight=w), _flow(_weight), wide=True)
member_query(
    "index_fund_flow_two", ("fund_flow_ratio",), lambda m, s: ixf.fund_flow_ratio(m, s.withColumn("sinflow", F.col("linflow") * 0.5 + 1), 20, ["linflow", "sinflow"], ["loutflow", "turnrate"]),
    _flow(f"CASE WHEN count(linflow + loutflow + turnrate) {over(20)} >= 20 THEN sum(abs(linflow * 1.5::DOUBLE + 1 - loutflow - turnrate)) {over(20)} END").replace(
        f"count(*) {over(20)} >= 20 THEN sum(linflow - loutflow)", f"count(turnrate) {over(20)} >= 20 THEN sum(linflow * 1.5::DOUBLE + 1 - loutflow - turnrate)"), wide=True,
)
_HELD = "CASE WHEN symbol::INT % 3 <> 0 THEN stk_share END"
_HOLD_MODES = [(c, w, p) for c in ("net", "absolute") for w in ("raw", "totmktcap", "negotiablemv", "amount") for p in ("industry", "held")]


def _holding(modes: list[tuple[str, str, str]], names: list[str], holding: str) -> str:
    out = []
    for (c, w, p), name in zip(modes, names, strict=True):
        mine, x = "true" if p == "industry" else "held", "n" if c == "net" else "b"
        if w == "raw":
            out.append(f"coalesce(sum(CASE WHEN {mine} THEN {x} END), 0) / nullif(coalesce(sum(CASE WHEN {mine} THEN a END), 0), 0) AS {name}")
        else:
            out.append(f"coalesce(sum(CASE WHEN {mine} THEN {w} * {x} / nullif(a, 0) END), 0) / nullif(sum(CASE WHEN {mine} THEN {w} END), 0) AS {name}")
    return f"""h0 AS (SELECT * REPLACE (coalesce(amount, 0) AS amount), {holding} AS h FROM st), h1 AS (SELECT *, coalesce(px * (h - {lagged("h", 1)}), 0) AS step FROM h0),
h2 AS (SELECT *, CASE WHEN count(*) {over(20)} >= 20 THEN sum(step) {over(20)} END AS n, CASE WHEN count(*) {over(20)} >= 20 THEN sum(abs(step)) {over(20)} END AS b,
  CASE WHEN count(amount) {over(20)} >= 20 THEN sum(amount) {over(20)} END AS a, count(h) OVER (PARTITION BY symbol) > 0 AS held FROM h1),
x AS (SELECT tradedate, index AS symbol, {", ".join(out)} {_MEM.format("h2")})"""


member_query(
    "index_holding_money", ("holding_money",), lambda m, s: ixf.holding_money(m, _with_amount(s), 20, "totmktcap", False, True, "stk_share"),
    _holding([("net", "totmktcap", "held")], ["holding_money"], "stk_share"), digits=5, wide=True,
)
member_query(
    "index_holding_modes", tuple("_".join(m) for m in _HOLD_MODES),
    lambda m, s: ixf.holding_moneys(m, _with_amount(s).withColumn("h", F.when(F.col("symbol").cast("int") % 3 != 0, F.col("stk_share"))), 20, _HOLD_MODES, "h"),
    _holding(_HOLD_MODES, ["_".join(m) for m in _HOLD_MODES], _HELD), digits=5, wide=True,
)
_W = f"CASE WHEN {lagged('turnrate', 20)} IS NOT NULL AND count(turnrate) {over(20)} >= 20 THEN ({lagged('turnrate', 20)} <> 0 AND count(*) FILTER (WHERE turnrate = 1) {over(20)} = 0)::INT END"
member_query(
    "index_chip_return", ("chip_return",), lambda m, s: ixf.chip_return(m, s.withColumn("turnrate", F.col("vol") / 100), 20),
    f"""w0 AS (SELECT *, {_W} AS w FROM st), a AS (SELECT *, CASE WHEN count(w) {over(20)} >= 20 AND sum(w) {over(20)} > 0 THEN px / {lagged("px", 20)} - 1 END AS r FROM w0),
x AS (SELECT tradedate, index AS symbol, avg(r) AS chip_return {_MEM.format("a")})""",
)


def _fit(fit: str) -> str:
    n = int(fit[2:])
    test = f"count(px) {over(n)} >= {n} AND px > avg(px) {over(n)} * (1 + 1e-9::DOUBLE)" if fit.startswith("ma") else f"px > {lagged('px', n)}"
    return f"coalesce({test}, false)::INT::DOUBLE"


def _strong(modes: list[tuple[str, str | None]], names: list[str], out: str) -> str:
    fits = list(dict.fromkeys(f for f, _ in modes))
    value = [f"avg(s_{f}) AS {name}" if w is None else f"coalesce(sum({w} * s_{f}), 0) / nullif(sum({w}), 0) AS {name}" for (f, w), name in zip(modes, names, strict=True)]
    return f"a AS (SELECT *, {', '.join(f'{_fit(f)} AS s_{f}' for f in fits)} FROM st), {out} AS (SELECT tradedate, index AS symbol, {', '.join(value)} {_MEM.format('a')})"


_STRONG_MODES = [(f, w) for f in ("ma60", "ma120", "gt220") for w in (None, "negotiablemv", "totmktcap", "amount")]
_STRONG_NAMES = tuple(f"{f}_{w or 'equal'}" for f, w in _STRONG_MODES)
member_query("index_strong_ratio", ("strong_ratio",), lambda m, s: ixf.strong_ratio(m, s, "ma60"), _strong([("ma60", None)], ["strong_ratio"], "x"), digits=3)
member_query("index_strong_modes", _STRONG_NAMES, lambda m, s: ixf.strong_ratios(m, s, _STRONG_MODES), _strong(_STRONG_MODES, list(_STRONG_NAMES), "x"), digits=3, wide=True)
_LEVEL = f"CASE WHEN count(v) {over(5)} >= 5 THEN avg(v) {over(5)} END / nullif(CASE WHEN count(v) {over(20)} >= 20 THEN avg(v) {over(20)} END, 0)"
for _kind, _change in ((1, f"x AS (SELECT tradedate, symbol, v - {lagged('v', 5)} AS strong_ratio FROM r)"), (2, f"x AS (SELECT tradedate, symbol, {_LEVEL} AS strong_ratio FROM r)"),
                       (3, f"y AS (SELECT tradedate, symbol, {_LEVEL} AS u FROM r), x AS (SELECT tradedate, symbol, u - {lagged('u', 20)} AS strong_ratio FROM y)")):
    member_query(
        "index_strong_short_long" if _kind == 2 else f"index_strong_short_long_{_kind}", ("strong_ratio",), lambda m, s, k=_kind: ixf.strong_short_to_long(m, s, "ma60", None, k),
        _strong([("ma60", None)], ["v"], "r") + ", " + _change, digits=3,
    )


@query(
    f"""WITH {MARKET}, {ASSETS}{IX.removeprefix(PANEL + "," + ASSETS)}, fc AS (SELECT tradedate, symbol, inflow - outflow - {lagged("(inflow - outflow)", 1)} AS c FROM g),
fl AS (SELECT tradedate, index AS symbol, coalesce(sum(c), 0) AS x {_MEM.format("fc")}),
b0 AS (SELECT ix.tradedate, ix.symbol, x, {_CH[1].replace("symbol", "ix.symbol").replace("tradedate", "ix.tradedate")} AS r FROM ix LEFT JOIN fl ON fl.symbol = ix.symbol AND fl.tradedate = ix.tradedate),
b1 AS (SELECT tradedate, symbol, x, r - {lagged("r", 1)} AS y, row_number() OVER ({_S}) AS n FROM b0), b2 AS (SELECT *, {lagged("y", 1)} AS z FROM b1),
p AS (SELECT t.symbol, t.tradedate, o.x, o.z FROM b2 t JOIN b2 o ON o.symbol = t.symbol AND o.n BETWEEN t.n - 19 AND t.n),
r AS (SELECT *, rank() OVER (PARTITION BY symbol, tradedate ORDER BY x) + (count(*) OVER (PARTITION BY symbol, tradedate, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, tradedate ORDER BY z) + (count(*) OVER (PARTITION BY symbol, tradedate, z) - 1) / 2.0 AS b FROM p),
c AS (SELECT symbol, tradedate, CASE WHEN count(x) = 20 AND count(z) = 20 THEN corr(a, b) END AS v FROM r GROUP BY ALL)
SELECT tradedate, symbol, {sql_rounded("v")} AS small_fund_corr FROM c"""
)
def index_small_fund_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tables.assets(spark, sf_dir).select("index", "symbol")
    out = ixf.small_fund_correlation(members, tables.market(spark, sf_dir), tables.index_market(spark, sf_dir))
    return out.select(*CELLS, rounded("small_fund_corr").alias("small_fund_corr"))
