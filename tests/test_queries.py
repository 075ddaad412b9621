"""Queries against their oracle SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from panelspark import catalog
from panelspark.plans import index_factors

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of every kind; the rest of the catalogue is compared by the driver.
CHOSEN = (
    "ts_mean", "ts_stddev", "ts_rank", "ts_reg_residual", "ts_argmax", "decay_std", "panel_binning", "panel_rank_avg", "panel_reg_residual", "winsorize",
    "clean", "asof_financials", "semi_pool", "trade_calendar", "incremental_merge", "fin_ttm", "fin_post_clean", "group_returns_fee", "ic_series", "indicators",
    "factors_beta", "factors_quality", "factors_growth", "ewm_mean", "ts_corr", "linear_residuals", "stock_pool", "fund_flow_residual", "index_returns", "index_hindenburg", "index_cross_volatility_std", "multi_factor_rank",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, dt.datetime):
        return str(v)[:10]
    return tuple(map(plain, v)) if isinstance(v, list) else str(v) if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    relation = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_pearson_equals_sql_without_frames_of_its_length(spark, duck, capsys):
    test_query_equals_sql(spark, duck, "ts_corr_pearson")
    catalog.QUERIES["ts_corr_pearson"](spark, SF).explain()
    assert "RowFrame, -19, currentrow" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["index_volume_quantile_756", "index_hindenburg_756", "index_hindenburg_top_756"])
def test_long_windows_equal_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)
    relation = duck.sql(catalog.ORACLES[name])
    value = next(i for i, c in enumerate(relation.columns) if c not in ("tradedate", "symbol"))
    assert sum(r[value] is not None for r in relation.fetchall()) > 0


def test_long_ranks_equal_brute_force(spark):
    named = {n for n in catalog.QUERIES if n.endswith("_756")}
    assert {n.removesuffix("_756") for n in named} == {n for n in catalog.QUERIES if n.startswith("index_rank_") and n not in named} | {"index_volume_quantile", "index_amount_ratio_quantile", "index_volume_ratio_quantile", "index_hindenburg", "index_hindenburg_top"}
    r = random.Random(5)
    values = [r.randrange(300) / 7 for _ in range(800)]
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(day + dt.timedelta(i), "x", v) for i, v in enumerate(values)], "tradedate date, symbol string, v double")
    got = [x["q"] for x in index_factors.history_rank(df, "v", "q").orderBy("tradedate").collect()]
    assert got[:755] == [None] * 755
    for i in range(755, 800):
        w = values[i - 755 : i + 1]
        assert got[i] == pytest.approx((sum(x < values[i] for x in w) + (w.count(values[i]) + 1) / 2) / 756)


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)))


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert __spark_entry__.entry(spark).count() == 6
