"""Queries over the rolling operators (one row a grid cell: tradedate, symbol, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import zero_if_null
from ..operators import grid, moving, recursive, series
from ..sources import landing, tables
from .registry import ASSETS, MARKET, PANEL, REPORTS, over, query, rounded, sql_rank_pct, sql_rounded

CELLS = ["tradedate", "symbol"]


def cell_query(name: str, expr: Callable[[], Column], sql: str | None, digits: int = 4, prelude: str = MARKET, frame: str = "g") -> None:
    """A query that evaluates one window expression on the market's grid."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.market(spark, sf_dir).select(*CELLS, rounded(expr(), digits).alias("value"))

    text = None if sql is None else f"WITH {prelude} SELECT tradedate, symbol, {sql_rounded('v', digits)} AS value FROM (SELECT tradedate, symbol, {sql} AS v FROM {frame})"
    query(text, name)(run)


def gate(value: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN {value} END"



def px() -> Column:
    return F.col("px")


def ret() -> Column:
    return F.col("ret")


def close() -> Column:
    return F.col("close")


def vol() -> Column:
    return F.col("vol")


cell_query("ts_mean", lambda: series.ts_mean(close(), 10, 2), gate(f"avg(close) {over(10)}", "close", 10, 2))
cell_query("ts_sum", lambda: series.ts_sum(px(), 10), gate(f"sum(px) {over(10)}", "px", 10, 10))
cell_query("ts_stddev", lambda: series.ts_stddev(close(), 20), gate(f"stddev_samp(close) {over(20)}", "close", 20, 2))
cell_query(
    "ts_cov", lambda: series.ts_cov(px(), vol(), 20), gate(f"covar_samp(px, vol) {over(20)}", "px + vol", 20, 2), 3
)
cell_query("ts_prod", lambda: series.ts_prod(1 + ret(), 5), gate(f"product(1 + ret) {over(5)}", "ret", 5, 5))
cell_query("ts_min", lambda: series.ts_min(close(), 15, 1), gate(f"min(close) {over(15)}", "close", 15, 1))
cell_query("ts_max", lambda: series.ts_max(close(), 15), f"CASE WHEN count(*) {over(15)} >= 15 THEN max(close) {over(15)} END")
cell_query("delta", lambda: series.delta(px(), 5), "px - lag(px, 5) OVER (PARTITION BY symbol ORDER BY tradedate)")
cell_query(
    "ts_argmax", lambda: series.ts_argmax(close(), 15, F.col("i"), 1).cast("double"),
    gate(f"-(max(CASE WHEN close IS NOT NULL THEN {{'x': close, 'r': -i}} END) {over(15)}).r + 1.0", "close", 15, 1),
)
cell_query(
    "ts_argmin", lambda: series.ts_argmin(close(), 15, F.col("i"), 1).cast("double"),
    gate(f"(min(CASE WHEN close IS NOT NULL THEN {{'x': close, 'r': i}} END) {over(15)}).r + 1.0", "close", 15, 1),
)
cell_query(
    "ts_rank", lambda: series.ts_rank(px(), 10, 10),
    f"CASE WHEN len(l) >= 10 THEN len(list_filter(l, lambda v: v < px)) + (len(list_filter(l, lambda v: v = px)) + 1) / 2.0 END",
    prelude=MARKET + f", f AS (SELECT *, list(px) FILTER (WHERE px IS NOT NULL) {over(10)} AS l FROM g)", frame="f",
)


@query(
    f"WITH {MARKET} SELECT tradedate, symbol, {sql_rounded('v')} AS value FROM (SELECT tradedate, symbol, "
    + gate(f"covar_pop(px, vol) {over(20)} / (stddev_pop(CASE WHEN vol IS NOT NULL THEN px END) {over(20)} * stddev_pop(CASE WHEN px IS NOT NULL THEN vol END) {over(20)})", "px + vol", 20, 20)
    + " AS v FROM g)"
)
def ts_corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, "i", "px", "vol")
    return moving.moving_correlation(m, 20, px(), vol(), "value").select(*CELLS, rounded("value").alias("value"))


_SLOPE = f"regr_slope(coalesce(ret, 0), coalesce(vol, 0)) {over(20)}"
_ICEPT = f"regr_intercept(coalesce(ret, 0), coalesce(vol, 0)) {over(20)}"
_FULL = f"count(*) {over(20)} >= 20"


def _regression(name: str, value: Callable[[], Column], sql: str, digits: int = 4) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = tables.market(spark, sf_dir).select(*CELLS, "i", "ret", "vol")
        m = moving.moving_regression(m, 20, ret(), vol(), "slope", "intercept")
        return m.select(*CELLS, rounded(value(), digits).alias("value"))

    query(f"WITH {MARKET} SELECT tradedate, symbol, {sql_rounded('v', digits)} AS value FROM (SELECT tradedate, symbol, CASE WHEN {_FULL} THEN {sql} END AS v FROM g)", name)(run)


_regression("ts_reg_slope", lambda: F.col("slope"), _SLOPE, 6)
_regression("ts_reg_intercept", lambda: F.col("intercept"), _ICEPT)
_regression("ts_reg_residual", lambda: zero_if_null(ret()) - F.col("slope") * zero_if_null(vol()) - F.col("intercept"), f"coalesce(ret, 0) - {_SLOPE} * coalesce(vol, 0) - {_ICEPT}")
cell_query("ts_coef_var", lambda: series.ts_coef_var(px(), 10), gate(f"stddev_pop(px) {over(10)} / avg(px) {over(10)}", "px", 10, 10))
cell_query("ts_zscore", lambda: series.ts_zscore(px(), 6), gate(f"(px - avg(px) {over(6)}) / nullif(stddev_samp(px) {over(6)}, 0)", "px", 6, 6), 3)
cell_query("ffill", lambda: grid.ffill(close()), "px")
cell_query("bfill", lambda: grid.bfill(close()), "first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
cell_query("pct_change", lambda: grid.change(px(), 5), "px / lag(px, 5) OVER (PARTITION BY symbol ORDER BY tradedate) - 1")
cell_query("forward_return", lambda: F.ln(grid.lag(px(), -5)) - F.ln(px()), "ln(lead(px, 5) OVER (PARTITION BY symbol ORDER BY tradedate)) - ln(px)")
cell_query("grid_densify", lambda: close(), "close", prelude=MARKET, frame="g")


def _decay(how: str, sql_how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = moving.decay(tables.market(spark, sf_dir).select(*CELLS, "i", "close"), "value", close(), 60, 42.0, how, 3)
        return m.select(*CELLS, rounded("value").alias("value"))

    text = f"""WITH {MARKET}, d AS (SELECT *, count(close) OVER (PARTITION BY symbol ORDER BY tradedate ROWS UNBOUNDED PRECEDING)::DOUBLE AS k FROM g)
SELECT tradedate, symbol, {sql_rounded("v")} AS value FROM (SELECT tradedate, symbol, CASE WHEN count(close) {over(60)} >= 3
  THEN {sql_how}(close * pow(2.0, k / 42.0)) {over(60)} * pow(2.0, -k / 42.0) END AS v FROM d)"""
    query(text, f"decay_{'sum' if how == 'sum' else 'std'}")(run)


_decay("sum", "sum")
_decay("std", "stddev_pop")


#: Ordinal ranks of a frame are the grade of its grade; unknown values come last.
_GRADE = "list_grade_up(list_grade_up(list({0}) OVER w, 'ASC', 'NULLS LAST'))"


@query(
    f"""WITH {MARKET}, r AS (SELECT tradedate, symbol, {_GRADE.format("px")} AS a, {_GRADE.format("vol")} AS b FROM g
  WINDOW w AS (PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT tradedate, symbol, {sql_rounded("CASE WHEN len(a) < 20 THEN 0.0 ELSE 1 - 6 * list_sum(list_transform(range(1, 21), lambda k: (a[k] - b[k]) * (a[k] - b[k])))::DOUBLE / (20 * 399.0) END")} AS value FROM r"""
)
def ts_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, "px", "vol")
    return recursive.ts_corr(m, "px", "vol", 20, "value").select(*CELLS, rounded("value").alias("value"))


_SO_FAR = "OVER (PARTITION BY symbol ORDER BY tradedate ROWS UNBOUNDED PRECEDING)"


@query(
    # y_k = c_k y_(k-1) + d_k over the known values, by the running product P of c: y_k = P_k sum(d_j / P_j).
    f"""WITH {MARKET}, k AS (SELECT tradedate, symbol, close, i, i - lag(i) OVER s AS gap FROM g WHERE close IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)),
w AS (SELECT *, pow(9 / 11.0::DOUBLE, gap) AS w FROM k), c AS (SELECT *, coalesce(w / (w + 2 / 11.0::DOUBLE), 1) AS c, coalesce(2 / 11.0::DOUBLE / (w + 2 / 11.0::DOUBLE), 1) * close AS d FROM w),
p AS (SELECT *, product(c) {_SO_FAR} AS p, row_number() OVER (PARTITION BY symbol ORDER BY tradedate) AS n FROM c), y AS (SELECT tradedate, symbol, n, p * sum(d / p) {_SO_FAR} AS y FROM p),
f AS (SELECT g.tradedate, g.symbol, last_value(y IGNORE NULLS) {_SO_FAR.replace("symbol ORDER BY tradedate", "g.symbol ORDER BY g.tradedate")} AS y, last_value(n IGNORE NULLS) {_SO_FAR.replace("symbol ORDER BY tradedate", "g.symbol ORDER BY g.tradedate")} AS n
  FROM g LEFT JOIN y ON y.symbol = g.symbol AND y.tradedate = g.tradedate)
SELECT tradedate, symbol, {sql_rounded("CASE WHEN n >= 3 THEN y END")} AS value FROM f"""
)
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, "close")
    return recursive.ewm_mean(m, "close", 10, 3, name="value").select(*CELLS, rounded("value").alias("value"))


def rsi_sql(source: str, x: str, n: int) -> str:
    """CTE rs (tradedate, symbol, v) of the index of x: means of the first n changes, then smoothed by 1 / n."""
    c = f"({n - 1} / {n}.0::DOUBLE)"

    def smooth(side: str) -> str:
        return f"pow({c}, k - {n}) * (avg(CASE WHEN k BETWEEN 1 AND {n} THEN {side} END) OVER (PARTITION BY symbol) + coalesce(sum(CASE WHEN k > {n} THEN {side} / {n} * pow({c}, {n} - k) END) {_SO_FAR}, 0))"

    return f"""kn AS (SELECT tradedate, symbol, row_number() OVER s - 1 AS k, {x} - lag({x}) OVER s AS d FROM {source} WHERE {x} IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)),
ud AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM kn), sm AS (SELECT tradedate, symbol, k, {smooth("up")} AS u, {smooth("down")} AS w FROM ud),
rs AS (SELECT x.tradedate, x.symbol, CASE WHEN k >= {n} THEN CASE WHEN u + w > 0 THEN 100 * u / (u + w) ELSE 0 END END AS v FROM {source} x LEFT JOIN sm USING (tradedate, symbol))"""


@query(f"WITH {MARKET}, {rsi_sql('g', 'px', 14)} SELECT tradedate, symbol, {sql_rounded('v')} AS value FROM rs")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, "px")
    return recursive.rsi(m, "px", 14, "value").select(*CELLS, rounded("value").alias("value"))


def _ols_sql() -> str:
    """CTEs that solve the normal equations of a frame by elimination and sum the squares of its residuals."""
    w = "OVER (PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
    pairs = [(j, k) for j in range(4) for k in range(j, 4)]
    out = f"""o0 AS (SELECT symbol, enddate AS tradedate, quarter(enddate)::DOUBLE AS x0, revenue AS x3 FROM reports),
o1 AS (SELECT *, lag(x0) OVER s AS x1, lead(x0) OVER s AS x2 FROM o0 WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)),
o2 AS (SELECT tradedate, symbol, list([x0, x1, x2, x3]) FILTER (WHERE x0 + x1 + x2 + x3 IS NOT NULL) {w} AS frame, {", ".join(f"avg(x{j}) {w} AS m{j}" for j in range(4))},
  {", ".join(f"covar_pop(x{j}, x{k}) {w} AS s{j}{k}" for j, k in pairs)} FROM o1), e0 AS (SELECT *, s11 AS v1, s22 AS v2 FROM o2)"""
    for j in range(3):
        ok = f"s{j}{j} > " + (f"1e-9::DOUBLE * v{j}" if j else "0")
        out += f", r{j} AS (SELECT *, {', '.join(f'CASE WHEN {ok} THEN s{j}{k} / s{j}{j} ELSE 0 END AS r{j}{k}' for k in range(j + 1, 4))} FROM e{j})"
        rest = [(k, m) for k in range(j + 1, 4) for m in range(k, 4)]
        out += f", e{j + 1} AS (SELECT * REPLACE ({', '.join(f's{k}{m} - r{j}{k} * s{j}{m} AS s{k}{m}' for k, m in rest)}) FROM r{j})"
    return out + """, b1 AS (SELECT *, r23 AS c2, r13 - r12 * r23 AS c1 FROM e3), b0 AS (SELECT *, r03 - r01 * c1 - r02 * c2 AS c0 FROM b1),
z AS (SELECT tradedate, symbol, CASE WHEN len(frame) >= 8 THEN sqrt(list_sum(list_transform(frame, lambda q: pow(q[4] - m3 - c0 * (q[1] - m0) - c1 * (q[2] - m1) - c2 * (q[3] - m2), 2))) / 8) END AS v FROM b0)"""


@query(f"WITH {REPORTS}, {_ols_sql()} SELECT tradedate, symbol, {sql_rounded('v', 2)} AS value FROM z")
def back_forth_residual_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.reports(spark, sf_dir).select("symbol", F.col("enddate").alias("tradedate"), "revenue", F.quarter("enddate").cast("double").alias("x"))
    return moving.rolling_ols_std(r, "revenue", "x", 8, "value").select(*CELLS, rounded("value", 2).alias("value"))


@query(
    f"""WITH {MARKET}, {REPORTS}, z AS (SELECT symbol, publishdate, enddate, CASE WHEN count(revenue) OVER w >= 6 THEN (revenue - avg(revenue) OVER w) / nullif(stddev_samp(revenue) OVER w, 0) END AS z
  FROM reports WINDOW w AS (PARTITION BY symbol ORDER BY enddate ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
p AS (SELECT symbol, publishdate AS tradedate, arg_max(z, enddate) AS v FROM z WHERE z IS NOT NULL GROUP BY ALL)
SELECT g.tradedate, g.symbol, {sql_rounded("last_value(v IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.tradedate ROWS UNBOUNDED PRECEDING)", 3)} AS value FROM g LEFT JOIN p ON p.symbol = g.symbol AND p.tradedate = g.tradedate"""
)
def normalized_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports' z-scores over six reports on the days they were published, filled forward on the grid."""
    days, symbols = tables.axes(spark, sf_dir)
    r = tables.reports(spark, sf_dir).withColumn("tradedate", F.col("enddate"))
    r = r.withColumn("z", series.ts_zscore(F.col("revenue"), 6)).filter("z is not null")
    r = r.groupBy("symbol", F.col("publishdate").alias("tradedate")).agg(F.max_by("z", "enddate").alias("v"))
    return grid.densify(r, days, symbols).select(*CELLS, rounded(grid.ffill(F.col("v")), 3).alias("value"))


_RESIDUALS = ("reg", "z_reg", "reg_resi", "slope", "qoq")
_W8 = "OVER (PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_LINEAR = f"""r0 AS (SELECT symbol, enddate AS tradedate, publishdate, revenue AS y, quarter(enddate) * 1000.0::DOUBLE + year(enddate) AS x FROM reports),
r1 AS (SELECT *, count(*) {_W8} AS n, regr_slope(y, x) {_W8} AS b, regr_intercept(y, x) {_W8} AS a, stddev_pop(y) {_W8} AS sy, stddev_pop(x) {_W8} AS sx,
  y / nullif(lag(y) OVER s, 0) - x / nullif(lag(x) OVER s, 0) AS qoq FROM r0 WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)),
r2 AS (SELECT tradedate, symbol, publishdate, CASE WHEN n >= 8 THEN y - b * x - a END AS reg, CASE WHEN n >= 8 AND sy > 0 THEN (y - b * x - a) / sy END AS z_reg,
  CASE WHEN n >= 8 THEN sqrt(greatest(sy * sy - b * b * sx * sx, 0)) END AS reg_resi, CASE WHEN n >= 8 THEN b END AS slope, qoq FROM r1)"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.reports(spark, sf_dir).select("symbol", F.col("enddate").alias("tradedate"), "publishdate", "revenue", (F.quarter("enddate") * 1000.0 + F.year("enddate")).alias("x"))
    return moving.linear_residuals(r, F.col("revenue"), F.col("x"))


@query(f"WITH {REPORTS}, {_LINEAR} SELECT tradedate, symbol, " + ", ".join(f"{sql_rounded(c, 2)} AS {c}" for c in _RESIDUALS) + " FROM r2")
def linear_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residuals(spark, sf_dir).select(*CELLS, *[rounded(c, 2).alias(c) for c in _RESIDUALS])


@query(
    f"""WITH {MARKET}, {REPORTS}, {_LINEAR}, p AS (SELECT symbol, publishdate AS tradedate, arg_max(slope, tradedate) AS v FROM r2 WHERE slope IS NOT NULL GROUP BY ALL)
SELECT g.tradedate, g.symbol, {sql_rounded("last_value(v IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.tradedate ROWS UNBOUNDED PRECEDING)", 2)} AS value FROM g LEFT JOIN p ON p.symbol = g.symbol AND p.tradedate = g.tradedate"""
)
def linear_slope_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of reports on the days they were published, if these are trading days, filled forward on the grid."""
    days, symbols = tables.axes(spark, sf_dir)
    r = _residuals(spark, sf_dir).filter("slope is not null").groupBy("symbol", F.col("publishdate").alias("tradedate")).agg(F.max_by("slope", "tradedate").alias("v"))
    return grid.densify(r, days, symbols).select(*CELLS, rounded(grid.ffill(F.col("v")), 2).alias("value"))


@query(f"WITH {MARKET} SELECT tradedate, symbol, {sql_rounded('v')} AS value FROM (SELECT tradedate, symbol, {sql_rank_pct('vol', 250)} AS v FROM g)")
def rolling_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, "vol")
    return recursive.rolling_rank_pct(m, "vol", 250, "value").select(*CELLS, rounded("value").alias("value"))


@query(
    f"WITH {PANEL} SELECT tradedate, symbol, "
    + ", ".join(f"{sql_rounded(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "amount", "inflow", "outflow"))
    + " FROM panel"
)
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("open", "high", "low", "close", "volume", "amount", "inflow", "outflow")
    return tables.panel(spark, sf_dir).select(*CELLS, *[rounded(c).alias(c) for c in fields])


@query(f"WITH {ASSETS} SELECT symbol, sector, index FROM assets")
def asset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.assets(spark, sf_dir)


@query(
    f"""WITH {PANEL} SELECT tradedate, symbol, field, {sql_rounded("value")} AS value
FROM (UNPIVOT (SELECT tradedate, symbol, open, close, volume FROM panel) ON open, close, volume INTO NAME field VALUE value)"""
)
def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.unpivot_fields(tables.panel(spark, sf_dir), ["open", "close", "volume"]).withColumn("value", rounded("value"))


_SYMBOLS = [f"{i:06d}" for i in range(1, 6)]


@query(f"WITH {PANEL} SELECT tradedate, " + ", ".join(sql_rounded(f"max(close) FILTER (WHERE symbol = '{s}')") + f" AS s{s}" for s in _SYMBOLS) + " FROM panel GROUP BY tradedate")
def pivot_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = landing.pivot_field(tables.panel(spark, sf_dir), "close", _SYMBOLS)
    return wide.select("tradedate", *[rounded(F.col(f"`{s}`")).alias(f"s{s}") for s in _SYMBOLS])
