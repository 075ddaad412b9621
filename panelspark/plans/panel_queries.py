"""Queries over cross-sectional operators, joins, universes and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, panel
from ..sources import landing, tables
from ..sources.factors import Factor, FactorStore
from ..sources.keyed import KeyedTable
from ..sources.scratch import Scratch, written
from . import universe
from .registry import ASSETS, MARKET, MARKET_CLOSE, PANEL, REPORTS, query, rounded, sql_rounded
from .series_queries import CELLS, cell_query, close, px, vol

D = "OVER (PARTITION BY tradedate)"
_RANK = "rank() OVER (PARTITION BY tradedate ORDER BY close IS NULL, close) + (count(*) OVER (PARTITION BY tradedate, close) - 1) / 2.0"

cell_query(
    "panel_rank", lambda: panel.panel_rank(close()).cast("double"),
    "CASE WHEN close IS NOT NULL THEN (row_number() OVER (PARTITION BY tradedate ORDER BY close IS NULL, close, symbol) - 1)::DOUBLE END",
)
cell_query("panel_rank_avg", lambda: panel.average_rank(close()), f"CASE WHEN close IS NOT NULL THEN {_RANK} END")
cell_query("panel_rank_pct", lambda: panel.rank_pct(close()), f"CASE WHEN close IS NOT NULL THEN ({_RANK}) / count(close) {D} END")
cell_query(
    "orthogonalize", lambda: panel.orthogonalize(px(), vol()),
    f"CASE WHEN px IS NOT NULL AND vol IS NOT NULL THEN px - regr_slope(px, vol) {D} * vol - regr_intercept(px, vol) {D} END", 3,
)
cell_query(
    "panel_reg_residual", lambda: panel.panel_reg_residual(close(), F.col("amount"), 0.2),
    f"CASE WHEN close IS NOT NULL AND count(close) {D} >= 0.2 * count(*) {D} THEN close - regr_slope(close, amount) {D} * amount - regr_intercept(close, amount) {D} END", 3,
)
cell_query("normalize", lambda: panel.normalize(close()), f"(close - avg(close) {D}) / stddev_samp(close) {D}")
cell_query("share_of_date", lambda: panel.share_of_date(F.col("volume")), f"volume / sum(volume) {D}")
cell_query("listed_days", lambda: panel.listed_days(close()).cast("double"), "(tradedate - min(CASE WHEN close IS NOT NULL THEN tradedate END) OVER (PARTITION BY symbol) + 1)::DOUBLE")
cell_query(
    "panel_binning", lambda: panel.panel_binning(px(), 5).cast("double"),
    "CASE WHEN px IS NOT NULL THEN least(5, len(list_filter(q, lambda e: e <= px)))::DOUBLE END",
    prelude=MARKET + ", e AS (SELECT tradedate, quantile_cont(px, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM g GROUP BY 1), b AS (SELECT * FROM g JOIN e USING (tradedate))", frame="b",
)
cell_query(
    "top_amount_99", lambda: panel.top_share(F.col("amount")).cast("double"),
    f"""CASE WHEN amount IS NOT NULL AND coalesce(sum(amount) OVER (PARTITION BY tradedate ORDER BY amount DESC NULLS LAST, symbol
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.99 * sum(amount) {D} THEN 1.0 END""",
)


@query(
    f"""WITH {MARKET}, m AS (SELECT *, median(close) {D} AS md FROM g), d AS (SELECT *, median(abs(close - md)) {D} AS mad FROM m)
SELECT tradedate, symbol, {sql_rounded("v")} AS value FROM (SELECT tradedate, symbol,
  CASE WHEN close IS NOT NULL THEN greatest(least(close, md + 5 * mad), md - 5 * mad) END AS v FROM d)"""
)
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, F.col("close").alias("value"))
    return panel.with_winsorized(m, "value").withColumn("value", rounded("value"))


@query(
    f"""WITH {MARKET}, k AS (SELECT tradedate, symbol, nullif(ret, 0) AS x FROM g), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM k),
c AS (SELECT tradedate, symbol, CASE WHEN x IS NOT NULL THEN greatest(least(x, b + 1.5 * (b - a)), a - 1.5 * (b - a)) END AS x FROM k, q)
SELECT tradedate, symbol, {sql_rounded("v")} AS value FROM (SELECT tradedate, symbol, (x - avg(x) {D}) / stddev_pop(x) {D} AS v FROM c)"""
)
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).select(*CELLS, F.col("ret").alias("value"))
    return panel.with_cleaned(m, "value").select(*CELLS, rounded("value").alias("value"))


@query(
    f"""WITH {MARKET}, {ASSETS} SELECT tradedate, symbol, {sql_rounded("v")} AS value FROM (
  SELECT tradedate, symbol, coalesce(close, median(close) OVER (PARTITION BY tradedate, sector)) AS v FROM g JOIN assets USING (symbol))"""
)
def fillna_by_sec_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.market(spark, sf_dir).join(tables.assets(spark, sf_dir), "symbol")
    return m.select(*CELLS, rounded(panel.sector_filled(close())).alias("value"))


@query(
    f"""WITH {MARKET}, {REPORTS}, days AS (SELECT DISTINCT tradedate FROM g), syms AS (SELECT DISTINCT symbol FROM g),
r AS (SELECT symbol, publishdate, arg_max(revenue, enddate) AS revenue FROM reports GROUP BY ALL)
SELECT d.tradedate, s.symbol, {sql_rounded("r.revenue", 2)} AS value
FROM days d CROSS JOIN syms s ASOF LEFT JOIN r ON r.symbol = s.symbol AND r.publishdate <= d.tradedate"""
)
def asof_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, symbols = tables.axes(spark, sf_dir)
    r = tables.reports(spark, sf_dir).groupBy("symbol", F.col("publishdate").alias("tradedate")).agg(F.max_by("revenue", "enddate").alias("value"))
    r = r.join(symbols, "symbol", "left_semi")
    return grid.asof(r, days, symbols, ["value"]).withColumn("value", rounded("value", 2))


_SPANS = """spans AS (SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").groupBy(tables.code(F.col("o_custkey")).alias("symbol"))
    return o.agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))


@query(
    f"""WITH {_SPANS}, days AS (SELECT DISTINCT last_day(l_shipdate::DATE) AS tradedate FROM lineitem)
SELECT symbol, tradedate FROM spans JOIN days ON tradedate >= lo AND tradedate <= hi"""
)
def interval_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.read(spark, sf_dir, "lineitem").select(F.last_day(F.col("l_shipdate").cast("date")).alias("tradedate")).distinct()
    return universe.members(_spans(spark, sf_dir), days, "lo", "hi", closed=True)


_MEMBERS = "AS (SELECT p.tradedate, p.symbol FROM panel p JOIN spans s ON s.symbol = p.symbol AND p.tradedate >= lo AND p.tradedate < hi)"


@query(f"WITH {PANEL}, {_SPANS}, pool {_MEMBERS} SELECT p.tradedate, p.symbol, {sql_rounded('close')} AS close FROM panel p SEMI JOIN pool USING (tradedate, symbol)")
def semi_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.panel(spark, sf_dir)
    s = _spans(spark, sf_dir).select(F.lit("all").alias("index"), F.col("symbol").alias("selectedsymbol"), F.col("lo").alias("selecteddate"), F.col("hi").alias("outdate"))
    s = s.join(p.select(F.col("symbol").alias("selectedsymbol")).distinct(), "selectedsymbol", "left_semi")
    pool = universe.stock_pool(s, universe.calendar(p))
    return p.join(pool, CELLS, "left_semi").select(*CELLS, rounded("close").alias("close"))


@query(f"WITH {PANEL} SELECT DISTINCT symbol FROM panel WHERE symbol NOT IN ('000001', '000003') AND symbol IN (SELECT lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier)")
def anti_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.tradable_assets(tables.panel(spark, sf_dir), tables.assets(spark, sf_dir), ("000001", "000003"))


_OLD, _NEW = "1999-06-30", "1999-06-01"


@query(
    f"""WITH {PANEL}, old AS (SELECT tradedate, symbol, close FROM panel WHERE tradedate <= DATE '{_OLD}'),
new AS (SELECT tradedate, symbol, close * 2 AS close FROM panel WHERE tradedate >= DATE '{_NEW}')
SELECT tradedate, symbol, {sql_rounded("close")} AS close FROM (SELECT * FROM old WHERE tradedate < (SELECT min(tradedate) FROM new) UNION ALL SELECT * FROM new)"""
)
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.panel(spark, sf_dir).select(*CELLS, "close")
    old, new = p.filter(F.col("tradedate") <= _OLD), p.filter(F.col("tradedate") >= _NEW).withColumn("close", F.col("close") * 2)
    return landing.overwrite_merge(old, new).select(*CELLS, rounded("close").alias("close"))


@query(
    f"""WITH {PANEL}, a AS (SELECT tradedate, symbol, close AS x FROM panel WHERE tradedate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'),
b AS (SELECT tradedate, symbol, volume AS y FROM panel WHERE volume > 20 AND tradedate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')
SELECT tradedate, symbol, {sql_rounded("x")} AS x, {sql_rounded("y")} AS y FROM a FULL JOIN b USING (tradedate, symbol)"""
)
def concat_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.panel(spark, sf_dir)
    both = {"x": p.select(*CELLS, F.col("close").alias("value")), "y": p.filter("volume > 20").select(*CELLS, F.col("volume").alias("value"))}
    return landing.concat_factors(both, "1996-01-01", "1997-12-31").select(*CELLS, rounded("x").alias("x"), rounded("y").alias("y"))


@query(
    f"""WITH {PANEL} SELECT tradedate, symbol, {sql_rounded("CASE WHEN tradedate > DATE '1997-12-01' THEN close * 3 WHEN symbol::INT % 3 = 0 AND tradedate BETWEEN DATE '1996-06-10' AND DATE '1996-09-30' THEN close * 2 ELSE close END")} AS close FROM panel"""
)
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made by three upserts: rows of the first years, late corrections of some keys, and the newest rows."""
    p, day = tables.panel(spark, sf_dir).select(*CELLS, "close"), F.col("tradedate")
    late = p.filter((F.col("symbol").cast("int") % 3 == 0) & day.between("1996-06-10", "1996-09-30"))
    with Scratch(spark) as tmp:
        table = KeyedTable(spark, tmp.folder())
        table.upsert(p.filter(day <= "1998-01-10"))
        table.upsert(late.withColumn("close", F.col("close") * 2))
        table.upsert(p.filter(day > "1997-12-01").withColumn("close", F.col("close") * 3))
        return written(table.read().select(*CELLS, rounded("close").alias("close")))


@query(f"WITH {MARKET} SELECT tradedate, symbol, {sql_rounded('px / lag(px, 5) OVER (PARTITION BY symbol ORDER BY tradedate) - 1')} AS value FROM g")
def factor_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored factor brought up to date after prices of a few days were corrected: equal to computing it anew."""
    m = tables.market(spark, sf_dir).select(*CELLS, "px")
    wrong = F.col("tradedate").between("1996-03-04", "1996-03-06") | (F.col("tradedate") == "1999-10-11")
    change5 = Factor("change_5", lambda p: p.withColumn("value", grid.change(F.col("px"), 5)), 5)
    with Scratch(spark) as tmp:
        m = tmp(m)
        store = FactorStore(spark, tmp.folder())
        store.update(change5, m.withColumn("px", F.when(wrong, F.col("px") * 7).otherwise(F.col("px"))))
        store.update(change5, m, m.filter(wrong))
        return written(store.table("change_5").read().select(*CELLS, rounded("value").alias("value")))


_INFO = """info AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, CASE WHEN s_suppkey % 7 = 3 THEN 'ST ' ELSE '' END || s_name AS sesname,
  CASE WHEN s_nationkey % 4 = 0 THEN '4' ELSE '1' END AS board, DATE '1995-03-01' + (s_suppkey % 50)::INT AS listdate,
  CASE WHEN s_suppkey % 5 = 0 THEN DATE '1900-01-01' WHEN s_suppkey % 11 = 1 THEN DATE '1999-01-01' END AS delistdate FROM supplier)"""


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return tables.read(spark, sf_dir, "supplier").select(
        tables.code(k).alias("symbol"),
        F.concat(F.when(k % 7 == 3, "ST ").otherwise(""), "s_name").alias("sesname"),
        F.when(F.col("s_nationkey") % 4 == 0, "4").otherwise("1").alias("board"),
        F.date_add(F.lit("1995-03-01").cast("date"), (k % 50).cast("int")).alias("listdate"),
        F.when(k % 5 == 0, F.lit("1900-01-01").cast("date")).when(k % 11 == 1, F.lit("1999-01-01").cast("date")).alias("delistdate"),
    )


#: Stocks of the pool queries: tradable ones, and those of one index (region 1) while they are its members.
_TRADABLE = f"""{PANEL}, {_INFO}, l AS (SELECT *, coalesce(nullif(delistdate, DATE '1900-01-01'), DATE '9999-12-31') AS hi FROM info),
c AS (SELECT d.tradedate, l.*, p.close, p.volume, tradedate BETWEEN listdate AND hi AS listed FROM (SELECT DISTINCT tradedate FROM panel) d CROSS JOIN l LEFT JOIN panel p USING (tradedate, symbol)),
w AS (SELECT *, sum(listed::INT) OVER s AS age, close / lag(close) OVER s - 1 AS pct FROM c WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)),
tradable AS (SELECT tradedate, symbol FROM w WHERE listed AND age > 120 AND sesname NOT LIKE '%ST %' AND volume IS NOT NULL
  AND NOT coalesce(pct > CASE WHEN board = '4' THEN 0.195 ELSE 0.095 END, false))"""


@query(f"WITH {_TRADABLE} SELECT tradedate, symbol FROM tradable")
def trade_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tradable(spark, sf_dir)


def _tradable(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """trade_calendar of all stocks, or of those in `only` (symbol)."""
    p, days = tables.panel(spark, sf_dir), tables.axes(spark, sf_dir)[0]
    # Names of the test data hold no other ST than the mark.
    info = _info(spark, sf_dir).withColumn("sesname", F.regexp_replace("sesname", "ST(?! )", "_"))
    if only is not None:
        p, info = (t.join(only, "symbol", "left_semi") for t in (p, info))
    return universe.trade_calendar(p, info, days)


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of indices (regions): symbol, selectedsymbol, selecteddate, outdate."""
    nation = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("string").alias("index"))
    supplier = tables.read(spark, sf_dir, "supplier").select(tables.code(F.col("s_suppkey")).alias("symbol"), "s_nationkey").join(nation, "s_nationkey")
    return _info(spark, sf_dir).join(supplier, "symbol").select(F.col("index").alias("symbol"), F.col("symbol").alias("selectedsymbol"), F.col("listdate").alias("selecteddate"), F.col("delistdate").alias("outdate"))


_POOL = f"""{_TRADABLE}, m AS (SELECT info.symbol, listdate, coalesce(nullif(delistdate, DATE '1900-01-01'), DATE '9999-12-31') AS hi FROM info
  JOIN supplier ON info.symbol = lpad(s_suppkey::VARCHAR, 6, '0') JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1)"""


@query(
    f"""WITH {_POOL} SELECT 'all' AS scope, tradedate, symbol FROM tradable UNION ALL SELECT '1', tradedate, symbol FROM tradable JOIN m USING (symbol) WHERE tradedate >= listdate AND tradedate < hi"""
)
def stock_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of all stocks that can be traded, and that of one index's members."""
    pools = [scope(spark, sf_dir, s).select(F.lit(s).alias("scope"), *CELLS) for s in ("all", "1")]
    return pools[0].union(pools[1])


def scope(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Pool of a scope: all tradable stocks, or those of an index."""
    membership = _membership(spark, sf_dir)
    if name == "all":
        return universe.scope_pool(name, _tradable(spark, sf_dir), membership)
    # Written, so that its size is known and it is broadcast if it is small.
    mine = written(membership.filter(F.col("symbol") == name))
    return universe.scope_pool(name, _tradable(spark, sf_dir, mine.select(F.col("selectedsymbol").alias("symbol"))), mine)


#: CTE pool (tradedate, symbol) of index 1 after the CTEs of PANEL.
POOL_SQL = _POOL.removeprefix(PANEL + ",") + ", pool AS (SELECT tradedate, symbol FROM tradable JOIN m USING (symbol) WHERE tradedate >= listdate AND tradedate < hi)"


@query(
    """WITH c AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, CASE WHEN s_suppkey % 9 = 0 THEN '0' WHEN s_suppkey % 7 = 0 THEN '2' ELSE '1' END AS status, n_nationkey::VARCHAR AS nation, n_regionkey::VARCHAR AS region
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT symbol, CASE WHEN status = '1' THEN region ELSE '0' END AS level1, CASE WHEN status <> '0' THEN nation ELSE '0' END AS level3 FROM c"""
)
def stock_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry of two levels: regions and nations; some entries have run out or are not in use."""
    n = tables.read(spark, sf_dir, "nation")
    s = tables.read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    unused, over = F.when(key % 9 == 0, "0").otherwise("1"), F.when(key % 7 == 0, F.lit("1997-01-01"))
    base = [tables.code(key).alias("selectedsymbol"), unused.alias("usestatus")]
    first = s.select(*base, F.lit("level 1").alias("estclass"), F.col("n_regionkey").cast("string").alias("symbol"), over.cast("date").alias("outdate"))
    third = s.select(*base, F.lit("level 3").alias("estclass"), F.col("n_nationkey").cast("string").alias("symbol"), F.lit(None).cast("date").alias("outdate"))
    assets = s.select(tables.code(key).alias("symbol"))
    return universe.industries(assets, first.union(third), "1998-12-31", {"level1": "level 1", "level3": "level 3"})


@query(
    """SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS symbol, n_name AS sesname, 'swlevel1' AS estclass FROM nation"""
)
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic information of the indices of one class, one row a symbol; regions are indices of another class."""
    n, r = tables.read(spark, sf_dir, "nation"), tables.read(spark, sf_dir, "region")
    level = n.select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_name").alias("sesname"), F.lit("swlevel1").alias("estclass"), F.lit(1).alias("no"))
    again = level.withColumns({"sesname": F.lit("a later entry"), "no": F.lit(2)})
    board = r.select(F.col("r_regionkey").cast("string").alias("symbol"), F.col("r_name").alias("sesname"), F.lit("board").alias("estclass"), F.lit(0).alias("no"))
    return universe.basic_info(again.union(level).union(board), "no", "swlevel1").select("symbol", "sesname", "estclass")


@query(
    f"""WITH {_INFO} SELECT index AS symbol, list_sort(list(DISTINCT symbol)) AS components FROM (
  SELECT info.*, n_regionkey::VARCHAR AS index FROM info JOIN supplier ON info.symbol = lpad(s_suppkey::VARCHAR, 6, '0') JOIN nation ON n_nationkey = s_nationkey)
WHERE listdate <= DATE '1998-01-01' AND coalesce(nullif(delistdate, DATE '1900-01-01'), DATE '9999-12-31') >= DATE '1998-01-01' GROUP BY index"""
)
def current_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.current_components(_membership(spark, sf_dir), "1998-01-01")


@query(f"WITH {MARKET_CLOSE} SELECT tradedate, {sql_rounded('close')} AS close, {sql_rounded('r', 6)} AS ret FROM (SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY tradedate) AS r FROM mc)")
def benchmark_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.market_close(spark, sf_dir)
    return universe.benchmark_returns(c, c).select("tradedate", rounded("close").alias("close"), rounded("ret", 6).alias("ret"))


@query(
    f"""WITH {PANEL} SELECT symbol, last_day(tradedate) AS tradedate, {sql_rounded("arg_max(close, tradedate) FILTER (WHERE close IS NOT NULL)")} AS close,
  {sql_rounded("arg_max(volume, tradedate) FILTER (WHERE volume IS NOT NULL)")} AS volume FROM panel GROUP BY symbol, last_day(tradedate)"""
)
def resample_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = universe.resample_last(tables.panel(spark, sf_dir), ["close", "volume"])
    return r.select("symbol", "tradedate", rounded("close").alias("close"), rounded("volume").alias("volume"))


@query(
    f"""WITH {MARKET}, l AS MATERIALIZED (SELECT tradedate, symbol, lead(ln(px), 1) OVER s - ln(px) AS f1, lead(ln(px), 5) OVER s - ln(px) AS f5, lead(ln(px), 20) OVER s - ln(px) AS f20
  FROM g WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)), a AS MATERIALIZED (SELECT *, avg(f1) OVER () AS a1, avg(f5) OVER () AS a5, avg(f20) OVER () AS a20 FROM l)
SELECT tradedate, symbol, {sql_rounded("f1 - a1")} AS ret_1, {sql_rounded("f5 - a5")} AS ret_5, {sql_rounded("f20 - a20")} AS ret_20 FROM a"""
)
def labels_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import labels

    out = labels.forward_labels(tables.market(spark, sf_dir), "px", (1, 5, 20))
    return out.select(*CELLS, *[rounded(c).alias(c) for c in ("ret_1", "ret_5", "ret_20")])


_AHEAD = ", ".join(f"lead(ln({p}), {n}) OVER s - ln({p}) AS f_{c}_{n}" for c, p in (("vwap", "vw"), ("px", "px")) for n in (1, 5, 20))
_AHEADS = [f"{c}_{n}" for c in ("vwap", "px") for n in (1, 5, 20)]


@query(
    f"""WITH {MARKET}, v AS (SELECT *, last_value(amount / volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY tradedate ROWS UNBOUNDED PRECEDING) AS vw FROM g),
l AS MATERIALIZED (SELECT tradedate, symbol, {_AHEAD} FROM v WINDOW s AS (PARTITION BY symbol ORDER BY tradedate)), a AS MATERIALIZED (SELECT *, {", ".join(f"avg(f_{c}) OVER () AS a_{c}" for c in _AHEADS)} FROM l)
SELECT tradedate, symbol, {", ".join(f"{sql_rounded(f'f_{c} - a_{c}')} AS ret_{c}" for c in _AHEADS)} FROM a"""
)
def labels_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two prices and three horizons."""
    from ..functions.numeric import ratio
    from . import labels

    m = tables.market(spark, sf_dir).withColumn("vwap", ratio(F.col("amount"), F.col("volume")))
    out = labels.forward_labels(m, ["vwap", "px"], (1, 5, 20))
    return out.select(*CELLS, *[rounded(f"ret_{c}").alias(f"ret_{c}") for c in _AHEADS])
