"""The engine's domain objects, derived from the star-schema tables of a data folder.

panel: lineitem by supplier and ship day; sectors and indices: nations and regions of the suppliers;
reports: orders by customer and quarter, cumulated in the year; market: the panel on its dense grid.
Sums of money and quantities are exact decimals, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import nonzero, ratio
from ..operators.grid import by_symbol, densify, ffill, lag


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(x: Column) -> Column:
    return F.lpad(x.cast("string"), 6, "0")


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tradedate, symbol, open, high, low, close, volume, amount, inflow, outflow; one row a traded day."""
    rows = read(spark, sf_dir, "lineitem").select(
        code(F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("date").alias("tradedate"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        "l_quantity", "l_extendedprice", "l_returnflag", F.struct("l_orderkey", "l_linenumber").alias("at"),
    )
    amount, volume = exact_sum(F.col("l_extendedprice")), exact_sum(F.col("l_quantity"))

    def flow(flag: str) -> Column:
        return exact_sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")).otherwise(0.0))

    return rows.groupBy("tradedate", "symbol").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        ratio(amount, volume).alias("close"), volume.alias("volume"), amount.alias("amount"),
        flow("R").alias("inflow"), flow("A").alias("outflow"),
    )


def axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calendar (tradedate) and assets (symbol) of the panel, from the two columns that hold them."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_shipdate").cast("date").alias("tradedate")).distinct(), rows.select(code(F.col("l_suppkey")).alias("symbol")).distinct()


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel on its grid, with row number i, filled price px, its log return and its fill of volume."""
    return _filled(densify(panel(spark, sf_dir), *axes(spark, sf_dir)))


def _filled(dense: DataFrame) -> DataFrame:
    filled = dense.withColumns(
        {"i": F.row_number().over(by_symbol()) - 1, "px": ffill(nonzero(F.col("close"))), "vol": ffill(nonzero(F.col("volume")))}
    )
    return filled.withColumn("ret", F.ln("px") - lag(F.ln("px"), 1))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector (nation) and index (region) of the suppliers."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(code(F.col("s_suppkey")).alias("symbol"), F.col("n_name").alias("sector"), F.col("r_name").alias("index"))


def market_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of the whole market by day."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("tradedate"))
    return rows.agg(ratio(exact_sum(F.col("l_extendedprice")), exact_sum(F.col("l_quantity"))).alias("close"))


def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's fields of an index: its members' sums, and close = amount / volume; symbol is the index."""
    p = panel(spark, sf_dir).join(assets(spark, sf_dir), "symbol")
    sums = {c: exact_sum(F.col(c)) for c in ("volume", "amount", "inflow", "outflow")}
    return p.groupBy("tradedate", F.col("index").alias("symbol")).agg(
        *[x.alias(c) for c, x in sums.items()], ratio(sums["amount"], sums["volume"]).alias("close"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "symbol").alias("open"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, enddate, publishdate, revenue (cumulated in the year) and quarter value; gaps are real."""
    rows = read(spark, sf_dir, "orders").select(
        code(F.col("o_custkey")).alias("symbol"),
        F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2)).alias("enddate"),
        "o_totalprice",
    )
    quarters = rows.groupBy("symbol", "enddate").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("x"))
    w = W.partitionBy("symbol", F.year("enddate")).orderBy("enddate").rowsBetween(W.unboundedPreceding, 0)
    late = F.pmod(F.col("symbol").cast("int"), F.lit(5)) * 30
    return quarters.select("symbol", "enddate", F.date_add("enddate", 20 + late).alias("publishdate"), F.sum("x").over(w).cast("double").alias("revenue"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned reports by publishing day: revenue (cumulated), revenue_ttm and their lags 1..3."""
    from ..plans import financials as fin

    full = fin.to_trailing_year(fin.preprocess(reports(spark, sf_dir)), ["revenue"])
    return fin.post_clean(fin.with_lags(full, ["revenue", "revenue_ttm"], 3))


def _with_prices(m: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the benchmark return and the fields that prices and volumes give, by fixed rules."""
    bench = market_close(spark, sf_dir).withColumn("bm_ret", F.ln("close") - F.lag(F.ln("close"), 1).over(W.orderBy("tradedate")))
    # One row a day: densify has checked the calendar's size (grid.MOST_DAYS).
    m = m.join(F.broadcast(bench.select("tradedate", "bm_ret")), "tradedate")
    return m.withColumns({
        "negotiablemv": F.col("px") * 800, "totmktcap": F.col("px") * 1000, "turnrate": F.col("vol") / 100, "stk_share": 1000.0 + F.col("i") / 100,
        "dy": F.col("close") / 1e5, "pe_fcst": F.col("px") / 50,
        "linflow": F.coalesce("inflow", F.lit(0.0)), "loutflow": F.coalesce("outflow", F.lit(0.0)), "pool": F.when(F.col("px").isNotNull() & (F.col("i") >= 60), 1.0),
    })


def priced_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market with the fields of the stock factors that need no statement; no report is read."""
    return _with_prices(market(spark, sf_dir), spark, sf_dir)


def stock_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market with the benchmark return and the fields of the stock factors, all derived by fixed rules.

    Statement fields are 0 before the first report, as the as-of reader gives them.
    """
    days, assets = axes(spark, sf_dir)
    fields = ["revenue", "revenue_ttm", *[f"revenue_{i}" for i in (1, 2, 3)]]
    mine = statements(spark, sf_dir).join(assets, "symbol", "left_semi").select("tradedate", "symbol", *fields)
    m = _with_prices(_filled(densify(panel(spark, sf_dir), days, assets, mine)), spark, sf_dir)
    r, t = F.col("revenue"), F.col("revenue_ttm")
    own = {"net_revenue_fcst": t * 1.4e-5, "net_revenue_fcst_2": t * 1.2e-5 - 0.3}
    reported = {
        "bizinco_ttm": t, "bizcost_ttm": t * 0.6 + 1000, "parenetp_ttm": t * 0.1 - 5000, "mananetr_ttm": t * 0.12 - 6000,
        "bizinco": r, "bizcost": r * 0.6 + 1000, "mainbizinco": r * 0.9, "mainbizcost": r * 0.5 + 500, "parenetp": r * 0.1 - 5000, "mananetr": r * 0.12 - 6000,
        "prest": r * 0.01, "perbond": r * 0.002, "righaggr": r * 2.2 - 9000, "totliab": r * 3 - 2000, "totalnoncliab": r, "totcurrasset": r * 2.5, "totalcurrliab": r * 1.5 + 100,
    }
    for i in ("", "_1", "_2", "_3"):
        reported |= {f"paresharrigh{i}": F.col(f"revenue{i}") * 2 - 10000, f"totasset{i}": F.col(f"revenue{i}") * 5}
    return m.withColumns(own | {c: F.coalesce(x, F.lit(0.0)) for c, x in reported.items()})


def index_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_panel on its grid with positive levels and bm, the market's close."""
    from ..plans.index_factors import positive_levels

    ix = positive_levels(densify(index_panel(spark, sf_dir)))
    # One row a day: densify has checked the calendar's size (grid.MOST_DAYS).
    return ix.join(F.broadcast(market_close(spark, sf_dir).withColumnRenamed("close", "bm")), "tradedate")
