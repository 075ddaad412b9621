"""Registry of the engine's queries and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


#: Values from here on have no more digits than a double holds and stay as they are.
_WHOLE = 2.0**52


def rounded(x: Column | str, digits: int = 4) -> Column:
    """Rounded for comparison, by floor(x 10^d + 0.4987) so that both engines agree; NaN is NULL.

    Exact ties (prices of few decimals) fall on the same side as the shift is not one half.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    small = F.floor(x * scale + 0.4987).cast("double") / scale
    return F.when(F.isnan(x), None).when(F.abs(x * scale) < _WHOLE, small).otherwise(x)


def sql_rounded(expression: str, digits: int = 4) -> str:
    scale = float(10**digits)
    x = f"({expression})"
    small = f"floor({x} * {scale}::DOUBLE + 0.4987::DOUBLE)::BIGINT::DOUBLE / {scale}::DOUBLE"
    return f"CASE WHEN NOT isfinite({x}) THEN NULL WHEN abs({x} * {scale}::DOUBLE) < {_WHOLE} THEN {small} ELSE {x} END"


def sql_rank_pct(x: str, n: int) -> str:
    """Average rank of x among the known values of its last n rows over their number, which must be n."""
    w = f"(PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    rank = f"(rank(ORDER BY {x} NULLS LAST) OVER {w} + count({x}) OVER {w} - (rank(ORDER BY {x} DESC NULLS LAST) OVER {w}) + 1) / 2.0"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {w} >= {n} THEN ({rank}) / count({x}) OVER {w} END"


# --- the domain objects of sources/tables.py in SQL --------------------------------------------

PANEL = """
px AS (
  SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate::DATE AS tradedate, l_extendedprice / l_quantity AS price,
    l_quantity::DECIMAL(18,2) AS q, l_extendedprice::DECIMAL(18,2) AS e, l_returnflag, l_orderkey, l_linenumber FROM lineitem
), panel AS (
  SELECT tradedate, symbol, arg_min(price, {'a': l_orderkey, 'b': l_linenumber}) AS open, max(price) AS high, min(price) AS low,
    sum(e)::DOUBLE / sum(q)::DOUBLE AS close, sum(q)::DOUBLE AS volume, sum(e)::DOUBLE AS amount,
    coalesce(sum(e) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS inflow,
    coalesce(sum(e) FILTER (WHERE l_returnflag = 'A'), 0)::DOUBLE AS outflow
  FROM px GROUP BY ALL
)"""

MARKET = (
    PANEL
    + """, g0 AS (
  SELECT c.tradedate, a.symbol, open, high, low, close, volume, amount, inflow, outflow
  FROM (SELECT DISTINCT tradedate FROM panel) c CROSS JOIN (SELECT DISTINCT symbol FROM panel) a LEFT JOIN panel p USING (tradedate, symbol)
), g1 AS (
  SELECT *, row_number() OVER s - 1 AS i, last_value(nullif(close, 0) IGNORE NULLS) OVER s AS px,
    last_value(nullif(volume, 0) IGNORE NULLS) OVER s AS vol
  FROM g0 WINDOW s AS (PARTITION BY symbol ORDER BY tradedate ROWS UNBOUNDED PRECEDING)
), g AS (SELECT *, ln(px) - lag(ln(px)) OVER (PARTITION BY symbol ORDER BY tradedate) AS ret FROM g1)"""
)

ASSETS = """
assets AS (
  SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, n_name AS sector, r_name AS index
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

MARKET_CLOSE = """
mc AS (SELECT l_shipdate::DATE AS tradedate, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS close
  FROM lineitem GROUP BY 1)"""

INDEX = (
    PANEL
    + ","
    + ASSETS
    + """, ip AS (
  SELECT tradedate, index AS symbol, sum(volume::DECIMAL(18,2))::DOUBLE AS volume, sum(amount::DECIMAL(18,2))::DOUBLE AS amount,
    sum(inflow::DECIMAL(18,2))::DOUBLE AS inflow, sum(outflow::DECIMAL(18,2))::DOUBLE AS outflow,
    sum(amount::DECIMAL(18,2))::DOUBLE / sum(volume::DECIMAL(18,2))::DOUBLE AS close, max(high) AS high, min(low) AS low, arg_min(open, symbol) AS open
  FROM panel JOIN assets USING (symbol) GROUP BY tradedate, index
), ig0 AS (
  SELECT c.tradedate, a.symbol, ip.* EXCLUDE (tradedate, symbol)
  FROM (SELECT DISTINCT tradedate FROM ip) c CROSS JOIN (SELECT DISTINCT symbol FROM ip) a LEFT JOIN ip USING (tradedate, symbol)
), ig AS (
  SELECT tradedate, symbol, """
    + ", ".join(
        f"last_value(nullif({c}, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY tradedate ROWS UNBOUNDED PRECEDING) AS {c}"
        for c in ("open", "high", "low", "close", "volume", "amount")
    )
    + """, inflow, outflow FROM ig0
)"""
)

REPORTS = """
q AS (
  SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS enddate,
    sum(o_totalprice::DECIMAL(18,2)) AS x FROM orders GROUP BY ALL
), reports AS (
  SELECT symbol, enddate, (enddate + (20 + (symbol::INT % 5) * 30)::INT)::DATE AS publishdate,
    (sum(x) OVER (PARTITION BY symbol, year(enddate) ORDER BY enddate ROWS UNBOUNDED PRECEDING))::DOUBLE AS revenue FROM q
)"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY tradedate ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
