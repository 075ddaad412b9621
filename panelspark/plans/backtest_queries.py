"""Queries over the quantile backtest, ending in the flagship: monthly 20-day reversal in five bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, panel
from ..sources import tables
from ..sources.scratch import written
from . import backtest as bt
from . import labels, universe
from .panel_queries import POOL_SQL, scope
from .registry import ASSETS, MARKET, query, rounded, sql_rounded

Q, FEE = 5, 0.001
CELLS = ["tradedate", "symbol"]


def reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor (winsorized and normalized -20-day return) as value, and price px, in one frame."""
    m = tables.market(spark, sf_dir)
    raw = m.select(*CELLS, "px", (-grid.change(F.col("px"), 20)).alias("value"))
    return panel.with_standard(raw, "value").select(*CELLS, "value", "px")


def cells(spark: SparkSession, sf_dir: str, q: int = Q, pool: DataFrame | None = None) -> DataFrame:
    # Every figure of the backtest reads the binned cells.
    return written(bt.binned(universe.align_panel(reversal(spark, sf_dir), "value", "px", pool), q))


_D = "OVER (PARTITION BY tradedate)"
_S = "PARTITION BY symbol ORDER BY tradedate"
FACTOR = (
    MARKET
    + f""", f0 AS (SELECT tradedate, symbol, -(px / lag(px, 20) OVER ({_S}) - 1) AS x FROM g),
f1 AS (SELECT *, median(x) {_D} AS md FROM f0), f2 AS (SELECT *, median(abs(x - md)) {_D} AS mad FROM f1),
f3 AS (SELECT tradedate, symbol, CASE WHEN x IS NOT NULL THEN greatest(least(x, md + 5 * mad), md - 5 * mad) END AS x FROM f2),
factor AS (SELECT tradedate, symbol, CASE WHEN stddev_samp(x) {_D} > 0 THEN (x - avg(x) {_D}) / stddev_samp(x) {_D} END AS x FROM f3)"""
)
ALIGNED = (
    FACTOR
    + f""", fm AS (SELECT symbol, last_day(tradedate) AS tradedate, arg_max(x, tradedate) AS factor FROM factor WHERE x IS NOT NULL GROUP BY ALL),
pm AS (SELECT symbol, last_day(tradedate) AS tradedate, arg_max(px, tradedate) AS p FROM g GROUP BY ALL),
al AS (SELECT d.tradedate, s.symbol, factor, last_value(p IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS p
  FROM (SELECT DISTINCT tradedate FROM fm) d CROSS JOIN (SELECT DISTINCT symbol FROM fm) s LEFT JOIN fm USING (tradedate, symbol) LEFT JOIN pm USING (tradedate, symbol)),
ar AS (SELECT tradedate, symbol, factor, lead(p) OVER ({_S}) / p - 1 AS fwd FROM al),
ed AS (SELECT tradedate, quantile_cont(factor, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM ar GROUP BY 1),
cells AS (SELECT ar.*, CASE WHEN factor IS NOT NULL THEN least({Q}, len(list_filter(q, lambda e: e <= factor))) END AS bin FROM ar JOIN ed USING (tradedate))"""
)
TURN = (
    ALIGNED
    + f""", moves AS (SELECT *, bin IS NOT NULL AND bin IS DISTINCT FROM lag(bin) OVER ({_S}) AS moved FROM cells),
turn AS (SELECT tradedate, CASE WHEN tradedate = (SELECT min(tradedate) FROM cells) THEN 0.0
  ELSE coalesce(sum(moved::INT)::DOUBLE / nullif(count(bin), 0), 0.0) END AS turnover FROM moves GROUP BY tradedate)"""
)

CALM = TURN.replace("cells AS (SELECT ar.*", "wild AS (SELECT ar.*").replace("FROM ar JOIN ed USING (tradedate))", "FROM ar JOIN ed USING (tradedate)), cells AS (SELECT * REPLACE (fwd / 20 AS fwd) FROM wild)")


def _groups(fee: float) -> str:
    return f""", gr AS (SELECT tradedate, bin, avg(fwd) - {fee} * any_value(turnover) AS ret FROM cells JOIN turn USING (tradedate) WHERE bin IS NOT NULL GROUP BY ALL
  UNION ALL SELECT tradedate, 0, avg(fwd) FROM cells WHERE bin IS NOT NULL GROUP BY ALL),
sd AS (SELECT *, "long" - short AS long_short FROM (SELECT tradedate, max(ret) FILTER (WHERE bin = {Q}) AS "long", max(ret) FILTER (WHERE bin = 1) AS short, max(ret) FILTER (WHERE bin = 0) AS passive FROM gr GROUP BY 1))"""


@query(f"WITH {ALIGNED} SELECT tradedate, symbol, {sql_rounded('factor')} AS factor, {sql_rounded('fwd')} AS fwd, bin::INT AS bin FROM cells")
def align_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(*CELLS, rounded("factor").alias("factor"), rounded("fwd").alias("fwd"), "bin")


@query(f"WITH {TURN} {_groups(0.0)} SELECT tradedate, bin::INT AS bin, {sql_rounded('ret')} AS ret FROM gr")
def group_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.group_returns(cells(spark, sf_dir)).select("tradedate", "bin", rounded("ret").alias("ret"))


@query(f"WITH {TURN} {_groups(FEE)} SELECT tradedate, bin::INT AS bin, {sql_rounded('ret', 6)} AS ret FROM gr")
def group_returns_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.group_returns(cells(spark, sf_dir), FEE).select("tradedate", "bin", rounded("ret", 6).alias("ret"))


@query(f"WITH {TURN} {_groups(0.0)} SELECT bin::INT AS bin, count(ret) AS months, {sql_rounded('avg(ret)', 6)} AS mean_ret, {sql_rounded('stddev_samp(ret)', 6)} AS std_ret FROM gr GROUP BY bin")
def reversal_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bt.group_returns(cells(spark, sf_dir))
    return g.groupBy("bin").agg(F.count("ret").alias("months"), rounded(F.avg("ret"), 6).alias("mean_ret"), rounded(F.stddev_samp("ret"), 6).alias("std_ret"))


#: The flagship's own setting: ten bins within an index's pool, with fees.
BINS = 10
_POOLED = FACTOR + ", " + POOL_SQL + ", " + TURN.removeprefix(FACTOR + ", ").replace("FROM factor WHERE x IS NOT NULL GROUP BY ALL", "FROM factor JOIN pool USING (tradedate, symbol) WHERE x IS NOT NULL GROUP BY ALL")
_POOLED = _POOLED.replace("[0, 0.2, 0.4, 0.6, 0.8, 1]", str([i / BINS for i in range(BINS + 1)])).replace(f"least({Q}, len(", f"least({BINS}, len(")


@query(
    f"""WITH {_POOLED} {_groups(FEE).replace(f"bin = {Q})", f"bin = {BINS})")}
SELECT bin::INT AS bin, count(ret) AS months, {sql_rounded('avg(ret)', 5)} AS mean_ret, {sql_rounded('stddev_samp(ret)', 5)} AS std_ret FROM gr GROUP BY bin"""
)
def reversal_backtest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reversal in ten bins of the stocks that are tradable members of index 1, after fees."""
    binned = cells(spark, sf_dir, BINS, written(scope(spark, sf_dir, "1")))
    g = bt.group_returns(binned, FEE)
    return g.groupBy("bin").agg(F.count("ret").alias("months"), rounded(F.avg("ret"), 5).alias("mean_ret"), rounded(F.stddev_samp("ret"), 5).alias("std_ret"))


@query(
    f"""WITH {TURN} {_groups(0.0)} SELECT tradedate, bin::INT AS bin, {sql_rounded("v")} AS log_value FROM (
  SELECT tradedate, bin, 1 + ln(product(1 + coalesce(ret, 0)) OVER (PARTITION BY bin ORDER BY tradedate ROWS UNBOUNDED PRECEDING)) AS v FROM gr)"""
)
def net_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = bt.net_values(bt.group_returns(cells(spark, sf_dir)), log=True)
    return values.select("tradedate", "bin", rounded("value").alias("log_value"))


def _side(spark: SparkSession, sf_dir: str, fee: float = 0.0) -> DataFrame:
    return bt.sides(bt.group_returns(cells(spark, sf_dir), fee), Q)


_CUM = "OVER (ORDER BY tradedate ROWS UNBOUNDED PRECEDING)"
_SIDES = ("long", "short", "long_short", "passive")


@query(
    f"WITH {TURN} {_groups(0.0)} SELECT tradedate, "
    + ", ".join(f'{sql_rounded(f"v_{c}")} AS "{c}"' for c in _SIDES)
    + " FROM (SELECT tradedate, "
    + ", ".join(f'ln(product(1 + coalesce("{c}", 0)) {_CUM}) AS v_{c}' for c in _SIDES)
    + " FROM sd)"
)
def side_net_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.side_net_values(_side(spark, sf_dir)).select("tradedate", *[rounded(F.ln(c)).alias(c) for c in _SIDES])


@query(
    f"""WITH {TURN} {_groups(0.0)}, lx AS (SELECT tradedate, sum(ln(1 + "long") - ln(1 + passive)) {_CUM} AS a, sum(ln(1 + short) - ln(1 + passive)) {_CUM} AS b,
  sum(ln(1 + "long") - ln(1 + short) - ln(1 + passive)) {_CUM} AS c FROM sd)
SELECT tradedate, {sql_rounded("a")} AS "long", {sql_rounded("b")} AS short, {sql_rounded("c")} AS long_short FROM lx"""
)
def log_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.log_excess(_side(spark, sf_dir)).select("tradedate", *[rounded(c).alias(c) for c in ("long", "short", "long_short")])


@query(
    f"""WITH {TURN} {_groups(0.0)}, nv AS (SELECT tradedate, product(1 + coalesce("long", 0)) {_CUM} AS v FROM sd)
SELECT tradedate, {sql_rounded("ln(v)")} AS log_value, {sql_rounded("d")} AS drawdown FROM (SELECT *, v / max(v) {_CUM} - 1 AS d FROM nv)"""
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.drawdown(_side(spark, sf_dir)).select("tradedate", rounded(F.ln("value")).alias("log_value"), rounded("drawdown").alias("drawdown"))


@query(f"WITH {TURN} {_groups(0.0)} SELECT bin::INT AS bin, {sql_rounded('avg(x)', 6)} AS mean_ret FROM (SELECT bin, ret - avg(ret) {_D} AS x FROM gr WHERE bin > 0) GROUP BY bin")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.group_means(bt.group_returns(cells(spark, sf_dir))).select("bin", rounded("mean_ret", 6).alias("mean_ret"))


IC = """, pr AS (SELECT tradedate, rank() OVER (PARTITION BY tradedate ORDER BY factor) + (count(*) OVER (PARTITION BY tradedate, factor) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY tradedate ORDER BY fwd) + (count(*) OVER (PARTITION BY tradedate, fwd) - 1) / 2.0 AS b FROM cells WHERE factor IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT tradedate, CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM pr GROUP BY 1)"""


@query(f"WITH {ALIGNED} {IC} SELECT tradedate, {sql_rounded('ic')} AS ic FROM ic")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.ic_series(cells(spark, sf_dir)).select("tradedate", rounded("ic").alias("ic"))


TURNOVER = f""", tr AS (SELECT tradedate, bin, avg(moved::INT::DOUBLE) AS share FROM moves WHERE bin IS NOT NULL AND tradedate > (SELECT min(tradedate) FROM moves WHERE bin IS NOT NULL) GROUP BY ALL),
tv AS (SELECT bin, avg(share) * 12 AS turnover FROM tr WHERE bin IN (1, {Q}) GROUP BY bin)"""


@query(f"WITH {TURN} {TURNOVER} SELECT bin::INT AS bin, {sql_rounded('turnover')} AS turnover FROM tv")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.turnover_rate(cells(spark, sf_dir), Q, "M").select("bin", rounded("turnover").alias("turnover"))


def _annual(x: str) -> str:
    return f"pow(product(1 + coalesce({x}, 0)), 12.0 / count(*)) - 1"


def _sharpe(x: str) -> str:
    return f"avg({x}) / stddev_samp({x}) * sqrt(12)"


_ROW = {
    "long_ret": _annual('"long"'), "short_ret": _annual("-short"), "long_short_ret": _annual("long_short"), "benchmark_ret": _annual("passive"),
    "long_sharpe": _sharpe('"long"'), "short_sharpe": _sharpe("-short"), "long_short_sharpe": _sharpe("long_short"),
    "long_calmar": f"({_annual('"long"')}) / max(dl)", "short_calmar": f"({_annual('-short')}) / max(ds)", "long_short_calmar": f"({_annual('long_short')}) / max(dls)",
    "info_ratio": _sharpe('("long" - passive)'), "long_vol": 'stddev_samp("long") * sqrt(12)', "short_vol": "stddev_samp(short) * sqrt(12)",
    "long_short_vol": "stddev_samp(long_short) * sqrt(12)", "win_rate": '(count(*) FILTER (WHERE "long" > 0))::DOUBLE / count("long")',
    "win_excess_rate": '(count(*) FILTER (WHERE "long" > passive))::DOUBLE / count("long")', "max_drawdown": "max(dl)",
}
_ICROW = {
    "ic_mean": "avg(ic)", "ic_std": "stddev_samp(ic)", "ic_skew": "skewness(ic)", "ic_kurt": "kurtosis(ic)",
    "icir": "avg(ic) / stddev_samp(ic) * sqrt(12)", "t": "avg(ic) / stddev_samp(ic) * sqrt(count(ic))", "ic_gt_0": "(count(*) FILTER (WHERE ic > 0))::DOUBLE / count(ic)",
}
_TURNROW = {"short_turnover": "max(turnover) FILTER (WHERE bin = 1)", "long_turnover": f"max(turnover) FILTER (WHERE bin = {Q})"}
_DATES = ("max_drawdown_start", "max_drawdown_end")


@query(
    f"""WITH {CALM} {_groups(FEE)} {IC} {TURNOVER}, nv AS (SELECT *, product(1 + coalesce("long", 0)) {_CUM} AS nl, product(1 + coalesce(-short, 0)) {_CUM} AS ns,
  product(1 + coalesce(long_short, 0)) {_CUM} AS nls FROM sd),
dd AS (SELECT *, 1 - nl / max(nl) {_CUM} AS dl, 1 - ns / max(ns) {_CUM} AS ds, 1 - nls / max(nls) {_CUM} AS dls FROM nv),
en AS (SELECT min(tradedate) AS e FROM dd WHERE dl = (SELECT max(dl) FROM dd)),
st AS (SELECT arg_max(tradedate, {{'v': nl, 'd': -(tradedate - DATE '1970-01-01')}}) AS s FROM dd, en WHERE tradedate <= e),
a AS (SELECT """
    + ", ".join(f"{x} AS {k}" for k, x in _ROW.items())
    + " FROM dd), b AS (SELECT "
    + ", ".join(f"{x} AS {k}" for k, x in _ICROW.items())
    + " FROM ic), c AS (SELECT "
    + ", ".join(f"{x} AS {k}" for k, x in _TURNROW.items())
    + " FROM tv) SELECT "
    + ", ".join(f"{sql_rounded(k)} AS {k}" for k in (*_ROW, *_ICROW, *_TURNROW))
    + ", s AS max_drawdown_start, e AS max_drawdown_end, (e - s)::INT AS max_drawdown_duration FROM a, b, c, en, st"
)
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The months of the test tables bring several hundred per cent; a twentieth is a plausible return.
    row = bt.indicators(cells(spark, sf_dir).withColumn("fwd", F.col("fwd") / 20), Q, "M", FEE)
    return row.select(*[rounded(k).alias(k) for k in (*_ROW, *_ICROW, *_TURNROW)], *_DATES, "max_drawdown_duration")


@query(
    f"""WITH {FACTOR}, k AS (SELECT * FROM factor WHERE x IS NOT NULL), l AS (SELECT * FROM k WHERE tradedate = (SELECT max(tradedate) FROM k))
SELECT tradedate, symbol, {sql_rounded("x")} AS value, {sql_rounded("(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER ()")} AS pct FROM l"""
)
def last_factor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = bt.last_factor_view(reversal(spark, sf_dir), None)
    return view.select(*CELLS, rounded("value").alias("value"), rounded("pct").alias("pct"))


@query(
    f"""WITH {FACTOR}, {ASSETS}, {POOL_SQL}, kn AS (SELECT * FROM factor JOIN pool USING (tradedate, symbol) WHERE x IS NOT NULL), ls AS (SELECT * FROM kn WHERE tradedate = (SELECT max(tradedate) FROM kn))
SELECT tradedate, ls.symbol, {sql_rounded("x")} AS value, {sql_rounded("(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER ()")} AS pct, s_name AS name, sector
FROM ls LEFT JOIN assets USING (symbol) LEFT JOIN supplier ON ls.symbol = lpad(s_suppkey::VARCHAR, 6, '0')"""
)
def last_factor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's values within the pool, with the stocks' names and sectors."""
    s = tables.read(spark, sf_dir, "supplier").select(tables.code(F.col("s_suppkey")).alias("symbol"), F.col("s_name").alias("name"))
    names = tables.assets(spark, sf_dir).select("symbol", "sector").join(s, "symbol")
    view = bt.last_factor_view(reversal(spark, sf_dir).select(*CELLS, "value"), written(scope(spark, sf_dir, "1")), names)
    return view.select(*CELLS, rounded("value").alias("value"), rounded("pct").alias("pct"), "name", "sector")


@query(
    f"""WITH {FACTOR}, u AS (SELECT f.tradedate, f.symbol, f.x AS a, g.vol AS b FROM factor f JOIN g USING (tradedate, symbol)),
r AS (SELECT *, CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY a IS NULL, a) + (count(*) OVER (PARTITION BY tradedate, a) - 1) / 2.0 END
  - CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY tradedate ORDER BY b IS NULL, b) + (count(*) OVER (PARTITION BY tradedate, b) - 1) / 2.0 END AS s FROM u)
SELECT tradedate, symbol, CASE WHEN s IS NOT NULL THEN {sql_rounded("rank() OVER (PARTITION BY tradedate ORDER BY s IS NULL, s) + (count(*) OVER (PARTITION BY tradedate, s) - 1) / 2.0")} END AS value FROM r"""
)
def multi_factor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, F.col("vol").alias("b"))
    both = reversal(spark, sf_dir).select(*CELLS, F.col("value").alias("a")).join(m, CELLS)
    return labels.multi_factor(both, {"a": 1, "b": -1}).select(*CELLS, rounded("value").alias("value"))
