"""Extracts, versions and dimensions on small folders; quartiles and stacked regressions against numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel, recursive
from panelspark.plans import universe
from panelspark.sources import landing

DAY = dt.date(2024, 3, 1)


def days(spark, rows, cols="symbol string, d int, x double"):
    return spark.createDataFrame(rows, cols).withColumn("tradedate", F.date_add(F.lit(DAY), F.col("d"))).drop("d")


def test_table_is_brought_up_to_date(spark, tmp_path):
    days(spark, [("a", 0, 1.0), ("a", 40, 2.0), ("b", 45, 3.0)]).write.parquet(f"{tmp_path}/prices_20240420")
    days(spark, [("a", 0, 9.0)]).write.parquet(f"{tmp_path}/prices_20240101")
    asked = []

    def fetch(query):
        asked.append(query)
        return days(spark, [("a", 40, 5.0), ("b", 50, 6.0)])

    path = landing.update_table(spark, str(tmp_path), "prices", "20240501", "select * from p where d >= {}", fetch)
    # The last date is March 1st + 45 days; the extract begins 30 days before it.
    assert asked == ["select * from p where d >= 20240316"] and landing.newest(spark, str(tmp_path), "Prices") == path
    got = {(r["symbol"], (r["tradedate"] - DAY).days, r["x"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 0, 1.0), ("a", 40, 5.0), ("b", 50, 6.0)}
    with pytest.raises(FileNotFoundError):
        landing.newest(spark, str(tmp_path), "unknown")
    empty = days(spark, [("a", 0, 1.0)]).limit(0)
    landing.extract_incremental(empty, "select {}", fetch)
    assert asked[-1] == "select 19000101"
    assert landing.current_file(["x/old.parquet", "x/members_Curr.parquet"]) == "x/members_Curr.parquet"


def test_dimensions(spark, tmp_path):
    spark.createDataFrame([("1", "20240301", 2.0), ("1", "20240301", 2.0)], "SYMBOL string, TRADEDATE string, Close double").write.parquet(f"{tmp_path}/stock_sk_market_20240301")
    rows = [("1", f"{y}{md}", f"{y + int(md == '1231')}{p}", float(k)) for y in (2021, 2022) for k, (md, p) in enumerate((("0331", "0420"), ("0630", "0820"), ("0930", "1020"), ("1231", "0420")), 1)]
    spark.createDataFrame(rows, "symbol string, enddate string, publishdate string, revenue double").write.parquet(f"{tmp_path}/financials_income_20240301")
    (market,) = landing.load_dimension(spark, str(tmp_path), "stock_sk_market")
    assert [(r["symbol"], r["tradedate"], r["close"]) for r in market.collect()] == [("000001", DAY, 2.0)]
    ttm, mrq = landing.load_dimension(spark, str(tmp_path), "financials_income")
    last = ttm.orderBy(F.desc("enddate")).first()
    assert last["revenue_ttm"] == 4.0 and mrq.filter("enddate = '2022-09-30'").first()["revenue_mrq"] == 1.0
    with pytest.raises(ValueError):
        landing.load_dimension(spark, str(tmp_path), "weather")


@pytest.mark.parametrize("values", [np.random.default_rng(1).normal(size=5003), np.random.default_rng(2).integers(0, 4, 4001).astype(float), np.array([3.0]), np.array([1.0, 2.0])])
def test_quartiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(5)
    row = panel.quartiles(df, "x").first()
    assert (row["_q1"], row["_q3"]) == pytest.approx(tuple(np.percentile(values, [25, 75])), rel=1e-12)
    none = panel.quartiles(df.limit(0), "x").first()
    assert none["_q1"] is None


def test_stacked_regressions_equal_single_ones(spark):
    r = np.random.default_rng(4)
    y, x = r.normal(size=60), r.integers(1, 4, 60).astype(float)
    x[20:34] = 2.0  # singular designs
    y[45] = np.nan
    rows = [("a", k, None if np.isnan(q) else float(q), float(p)) for k, (q, p) in enumerate(zip(y, x, strict=True))]
    out = recursive.rolling_ols_std(days(spark, rows, "symbol string, d int, y double, x double"), "y", "x", 8, "s").orderBy("tradedate").collect()
    for t in range(60):
        a = np.column_stack([np.ones(8), x[t - 7 : t + 1], x[t - 8 : t], x[t - 6 : t + 2]]) if 8 <= t < 59 else None
        b = y[max(0, t - 7) : t + 1]
        if a is None or np.isnan(b).any():
            assert out[t]["s"] is None or np.isnan(out[t]["s"])
            continue
        assert out[t]["s"] == pytest.approx((b - a @ np.linalg.lstsq(a, b, rcond=None)[0]).std(), abs=1e-9)


def test_members_and_pools(spark):
    calendar = days(spark, [("-", k, 0.0) for k in (0, 1, 4, 5)]).select("tradedate")
    spans = spark.createDataFrame([("a", DAY - dt.timedelta(99), DAY + dt.timedelta(4)), ("b", DAY + dt.timedelta(2), dt.date(9999, 12, 31)), ("c", DAY + dt.timedelta(3), DAY), ("d", None, DAY)], "symbol string, lo date, hi date")

    def at(df):
        return {(r["symbol"], (r["tradedate"] - DAY).days) for r in df.collect()}

    assert at(universe.members(spans, calendar, "lo", "hi", True)) == {("a", 0), ("a", 1), ("a", 4), ("b", 4), ("b", 5)}
    assert at(universe.members(spans, calendar, "lo", "hi", False)) == {("a", 0), ("a", 1), ("b", 4), ("b", 5)}
    tradable = days(spark, [("a", 0, 0.0), ("a", 4, 0.0), ("b", 5, 0.0), ("e", 1, 0.0)])
    membership = spark.createDataFrame([("000300", "a", DAY, DAY + dt.timedelta(4)), ("000300", "b", dt.date(1900, 1, 1), None), ("000300", "e", DAY, dt.date(1900, 1, 1))], "symbol string, selectedsymbol string, selecteddate date, outdate date")
    assert at(universe.scope_pool("000300", tradable, membership)) == {("a", 0), ("e", 1)}
    assert at(universe.scope_pool("all", tradable)) == {("a", 0), ("a", 4), ("b", 5), ("e", 1)}


def test_pool_makes_the_tradable_cells_once(spark, capsys):
    """Whatever number of intervals a member has, its cells come once, and nothing is made a second time for the calendar."""
    tradable = spark.range(8).select(F.lit("a").alias("symbol"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("tradedate"))
    ends = [(0, 2), (1, 4), (6, 99), (5, 5)]
    membership = spark.createDataFrame([("x", "a", DAY + dt.timedelta(i), DAY + dt.timedelta(j)) for i, j in ends], "symbol string, selectedsymbol string, selecteddate date, outdate date")
    pool = universe.scope_pool("x", tradable, membership)
    pool.explain()
    assert capsys.readouterr().out.count("Range (") == 1
    assert sorted((r["tradedate"] - DAY).days for r in pool.collect()) == [0, 1, 2, 3, 6, 7]


def test_names_and_types(spark, tmp_path):
    assert landing.logical_path("out", "basic_info_index_board") == "out/basic_info/basic_info_index_board"
    assert landing.logical_path("out", "stock_pool_000300") == "out/trade_calendar/stock_pool_000300"
    assert landing.logical_path("out", "stock_close") == "out/factor/stock/close" and landing.logical_path("out", "index_close") == "out/factor/index/close"
    assert landing.logical_path("out", "size") == "out/processed_factors/size"
    with pytest.raises(ValueError):
        landing.logical_path("out", "../etc")
    days(spark, [("a", 0, 1.0)]).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/t")
    got = landing.read_typed(spark, f"{tmp_path}/t", "symbol string, tradedate date, n long")
    assert got.dtypes == [("symbol", "string"), ("tradedate", "date"), ("n", "bigint")] and got.count() == 1
    assert landing.read_typed(spark, f"{tmp_path}/t").columns == ["symbol", "x", "tradedate", "n"]
    for schema, error in (("volume double", ValueError), ("x long", TypeError), ("symbol int", TypeError)):
        with pytest.raises(error):
            landing.read_typed(spark, f"{tmp_path}/t", schema)
    with pytest.raises(TypeError):
        landing.read_typed(spark, f"{tmp_path}/t.csv")
