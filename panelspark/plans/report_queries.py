"""Queries over financial statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from . import financials as fin
from .registry import REPORTS, query, rounded, sql_rounded

KEYS = ["symbol", "enddate"]

_SNAP = """make_date((year(enddate) + CASE WHEN quarter(enddate) = 4 THEN 1 ELSE 0 END)::INT,
  CASE quarter(enddate) WHEN 2 THEN 8 WHEN 3 THEN 10 ELSE 4 END, 30)"""
_OK = """publishdate > enddate AND year(publishdate) = year(enddate) + CASE WHEN quarter(enddate) = 4 THEN 1 ELSE 0 END
  AND month(publishdate) <= CASE quarter(enddate) WHEN 2 THEN 8 WHEN 3 THEN 10 ELSE 4 END"""
ADJUSTED = REPORTS + f", adj AS (SELECT symbol, enddate, CASE WHEN {_OK} THEN publishdate ELSE {_SNAP} END AS publishdate, revenue FROM reports)"
FULL = (
    ADJUSTED
    + f""", ends AS (
  SELECT symbol, last_day((s + INTERVAL 2 MONTH)::DATE) AS enddate FROM (SELECT symbol,
    unnest(generate_series(date_trunc('quarter', min(enddate)), date_trunc('quarter', max(enddate)), INTERVAL 3 MONTH)) AS s FROM adj GROUP BY symbol)
), filled AS (SELECT e.symbol, e.enddate, a.publishdate AS p0, a.revenue FROM ends e LEFT JOIN adj a USING (symbol, enddate)),
full_ AS (SELECT symbol, enddate, coalesce(p0, {_SNAP}) AS publishdate, revenue FROM filled)"""
)
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY enddate)"
_TTM = """CASE WHEN quarter(enddate) = 4 THEN revenue ELSE coalesce(revenue + CASE quarter(enddate) WHEN 1 THEN lag(revenue, 1) OVER w
  WHEN 2 THEN lag(revenue, 2) OVER w ELSE lag(revenue, 3) OVER w END - lag(revenue, 4) OVER w, revenue * 4 / quarter(enddate)) END"""


@query(f"WITH {ADJUSTED} SELECT symbol, enddate, publishdate FROM adj")
def fin_adjust_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.adjust_publish_date(tables.reports(spark, sf_dir)).select(*KEYS, "publishdate")


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.preprocess(tables.reports(spark, sf_dir))


@query(f"WITH {FULL} SELECT symbol, enddate, publishdate, {sql_rounded('revenue', 2)} AS revenue FROM full_")
def fin_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).select(*KEYS, "publishdate", rounded("revenue", 2).alias("revenue"))


@query(
    f"""WITH {FULL} SELECT symbol, enddate, {sql_rounded("v", 2)} AS revenue_mrq FROM (
  SELECT symbol, enddate, CASE WHEN quarter(enddate) = 1 THEN revenue ELSE revenue - lag(revenue) OVER w END AS v FROM full_ {_W})"""
)
def fin_mrq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.to_single_quarter(_full(spark, sf_dir), ["revenue"]).select(*KEYS, rounded("revenue_mrq", 2).alias("revenue_mrq"))


@query(f"WITH {FULL} SELECT symbol, enddate, {sql_rounded('v', 2)} AS revenue_ttm FROM (SELECT symbol, enddate, {_TTM} AS v FROM full_ {_W})")
def fin_ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.to_trailing_year(_full(spark, sf_dir), ["revenue"]).select(*KEYS, rounded("revenue_ttm", 2).alias("revenue_ttm"))


@query(
    f"WITH {FULL} SELECT symbol, enddate, "
    + ", ".join(f"{sql_rounded(f'v{i}', 2)} AS revenue_{i}" for i in range(1, 5))
    + " FROM (SELECT symbol, enddate, "
    + ", ".join(f"lag(revenue, {i}) OVER w AS v{i}" for i in range(1, 5))
    + f" FROM full_ {_W})"
)
def fin_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"revenue_{i}" for i in range(1, 5)]
    return fin.with_lags(_full(spark, sf_dir), ["revenue"]).select(*KEYS, *[rounded(c, 2).alias(c) for c in names])


@query(
    f"""WITH {FULL}, t AS (SELECT symbol, enddate, publishdate, {_TTM} AS ttm FROM full_ {_W}), l AS (SELECT *, lag(ttm, 4) OVER w AS l4 FROM t {_W})
SELECT symbol, publishdate AS tradedate, {sql_rounded("arg_max({'v': ttm}, enddate).v", 2)} AS revenue_ttm, {sql_rounded("arg_max({'v': l4}, enddate).v", 2)} AS revenue_ttm_4
FROM l GROUP BY symbol, publishdate"""
)
def fin_post_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fin.trailing_year(tables.reports(spark, sf_dir), ["revenue"])
    return t.select("symbol", "tradedate", *[rounded(c, 2).alias(c) for c in ("revenue_ttm", "revenue_ttm_4")])
