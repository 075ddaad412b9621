"""Queries that land, version, format and read tables the way extracts do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel
from ..sources import landing, tables
from ..sources.scratch import Scratch, written
from . import labels
from .factor_queries import std
from .registry import MARKET, PANEL, REPORTS, query, rounded, sql_rounded
from .report_queries import _TTM, FULL
from .series_queries import CELLS


@query(f"WITH {PANEL}, {REPORTS} SELECT 'panel' AS name, max(tradedate) AS last_date FROM panel UNION ALL SELECT 'reports', max(enddate) FROM reports UNION ALL SELECT 'published', max(publishdate) FROM reports")
def last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where extracts go on: the greatest date of each table."""
    p, r = tables.panel(spark, sf_dir), tables.reports(spark, sf_dir)
    of = (("panel", p, "tradedate"), ("reports", r, "enddate"), ("published", r, "publishdate"))
    out = [landing.last_date(df, c).select(F.lit(name).alias("name"), "last_date") for name, df, c in of]
    return out[0].union(out[1]).union(out[2])


@query(
    f"""WITH {PANEL}, old AS (SELECT tradedate, symbol, close FROM panel WHERE tradedate <= DATE '2000-06-30'), first AS (SELECT max(tradedate) - 30 AS d FROM old)
SELECT tradedate, symbol, {sql_rounded("CASE WHEN tradedate >= d THEN close + 1 ELSE close END")} AS close FROM panel, first"""
)
def table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table brought up to date: the newest version, its last date, an extract of 30 days before it, and the merge."""
    p = tables.panel(spark, sf_dir).select(*CELLS, "close")
    with Scratch(spark) as tmp:
        folder, source = tmp.folder(), tmp(p.withColumn("close", F.col("close") + 1))
        landing.save_panel(p.filter(F.col("tradedate") <= "1997-01-31"), f"{folder}/prices_19970131")
        landing.save_panel(p.filter(F.col("tradedate") <= "2000-06-30"), f"{folder}/prices_20000630")

        def fetch(asked: str) -> DataFrame:
            return source.filter(F.col("tradedate") >= F.to_date(F.lit(asked.rsplit(" ", 1)[-1]), "yyyyMMdd"))

        path = landing.update_table(spark, folder, "prices", "20011231", "rows from {}", fetch)
        return written(landing.read_many(spark, [path]).select(*CELLS, rounded("close").alias("close")))


@query(
    f"""WITH r AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate::DATE AS tradedate, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS close, l_quantity AS volume FROM lineitem WHERE l_suppkey % 13 <> 5),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol, tradedate ORDER BY close NULLS FIRST, volume NULLS FIRST) AS n FROM r)
SELECT symbol, tradedate, {sql_rounded("close", 2)} AS close, {sql_rounded("volume", 2)} AS volume FROM o WHERE n = 1"""
)
def market_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw market extract (upper-case names, text dates, bare codes, NaN, repeated cells, rows without code) as the dimension reader gives it."""
    rows = tables.read(spark, sf_dir, "lineitem")
    raw = rows.select(
        F.when(F.col("l_suppkey") % 13 != 5, F.col("l_suppkey").cast("string")).alias("SYMBOL"), F.date_format("l_shipdate", "yyyyMMdd").alias("TRADEDATE"),
        F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_extendedprice")).alias("CLOSE"), F.col("l_quantity").alias("VOLUME"),
    )
    with Scratch(spark) as tmp:
        folder = tmp.folder()
        landing.save_panel(raw, f"{folder}/stock_sk_market_20240101")
        (market,) = landing.load_dimension(spark, folder, "stock_sk_market")
        return written(market.select("symbol", "tradedate", rounded("close", 2).alias("close"), rounded("volume", 2).alias("volume")))


_LATEST = "arg_max({{'v': {0}}}, enddate).v"


@query(
    f"""WITH {FULL}, t AS (SELECT *, {_TTM} AS ttm, CASE WHEN quarter(enddate) = 1 THEN revenue ELSE revenue - lag(revenue) OVER w END AS mrq FROM full_ WINDOW w AS (PARTITION BY symbol ORDER BY enddate)),
l AS (SELECT *, {", ".join(f"lag({c}, {i}) OVER w AS {c}_{i}" for c in ("ttm", "mrq", "revenue") for i in (1, 4))} FROM t WINDOW w AS (PARTITION BY symbol ORDER BY enddate)),
v AS (SELECT symbol, publishdate AS tradedate, {", ".join(f"{_LATEST.format(c + i)} AS {c}{i}" for c in ("ttm", "mrq", "revenue") for i in ("", "_1", "_4"))} FROM l GROUP BY ALL)
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS kind, symbol, tradedate, " + ", ".join(f"{sql_rounded(c + i, 2)} AS value{i}" for i in ("", "_1", "_4")) + " FROM v" for c in ("ttm", "mrq", "revenue"))
)
def statement_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three readings of a statement table, with lags: the trailing year, the quarter and the balance."""
    r = tables.reports(spark, sf_dir)
    with Scratch(spark) as tmp:
        folder = tmp.folder()
        for tag in ("financials_income", "financials_balance"):
            landing.save_panel(r, f"{folder}/{tag}_20240101")
        ttm, mrq = landing.load_dimension(spark, folder, "financials_income")
        (balance,) = landing.load_dimension(spark, folder, "financials_balance")
        parts = []
        for kind, name, df in (("ttm", "revenue_ttm", ttm), ("mrq", "revenue_mrq", mrq), ("revenue", "revenue", balance)):
            parts.append(df.select(F.lit(kind).alias("kind"), "symbol", "tradedate", *[rounded(f"{name}{i}", 2).alias(f"value{i}") for i in ("", "_1", "_4")]))
        return written(parts[0].union(parts[1]).union(parts[2]))


@query(f"WITH {MARKET} SELECT tradedate, symbol, {sql_rounded('CASE WHEN month(tradedate) IN (4, 8, 10) THEN px END')} AS due, {sql_rounded('CASE WHEN close IS NOT NULL THEN vol END')} AS published FROM g")
def publish_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field in the months in which reports are due, and one where another is known."""
    m = tables.market(spark, sf_dir).select(*CELLS, "px", "close", "volume")
    m = m.withColumns({"due": labels.adjust_to_quarter(F.col("px")), "published": labels.align_publish(F.col("volume"), F.col("close"))})
    return m.select(*CELLS, rounded("due").alias("due"), rounded("published").alias("published"))


@query(f"WITH {MARKET}, y AS (SELECT tradedate, symbol, close AS v FROM g), {std('y', 'z', 'v')} SELECT tradedate, symbol, {sql_rounded('v', 3)} AS value FROM z")
def transform_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps applied one after the other: zeros to NULL, winsorized, normalized."""
    m = tables.market(spark, sf_dir).select(*CELLS, F.col("close").alias("v"))
    out = panel.run(m, lambda d: d.withColumn("v", F.nullif("v", F.lit(0.0))), lambda d: panel.with_winsorized(d, "v"), lambda d: d.withColumn("v", panel.normalize(F.col("v"))))
    return out.select(*CELLS, rounded("v", 3).alias("value"))


@query(
    f"""WITH {REPORTS} SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, last_day((date_trunc('quarter', max(o_orderdate)) + INTERVAL 2 MONTH)::DATE) AS last_quarter FROM orders GROUP BY o_custkey"""
)
def report_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from bare numbers, and the end of the last quarter that has an order."""
    from ..functions.dates import quarter_end, symbol_code

    rows = tables.read(spark, sf_dir, "orders").groupBy(symbol_code(F.col("o_custkey").cast("string")).alias("symbol")).agg(F.max(F.col("o_orderdate").cast("date")).alias("day"))
    return rows.select("symbol", quarter_end(F.col("day")).alias("last_quarter"))
