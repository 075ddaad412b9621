"""Small hand-made panels: gaps, ties, all-NULL dates, zero denominators, single symbols, NaN at the source."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.dates import quarter_end, symbol_code
from panelspark.functions.numeric import finite, ratio, sample_kurtosis, sample_skewness
from panelspark.operators import grid, panel, recursive, series
from panelspark.plans import backtest, financials, universe
from panelspark.sources import landing

DAY = dt.date(2024, 1, 1)


def make(spark, rows, cols="i int, symbol string, x double"):
    df = spark.createDataFrame(rows, cols)
    return df.withColumn("tradedate", F.date_add(F.lit(DAY), F.col("i")))


def got(df, c, symbol="a"):
    return [r[c] for r in df.filter(F.col("symbol") == symbol).orderBy("tradedate").collect()]


def test_numeric_conventions(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), 2.0), (4.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, 4.0]
    assert [r[0] for r in df.select(ratio(F.lit(1.0), F.col("y"))).collect()] == [None, 0.5, None]
    v = pd.Series([1.0, 2.0, 4.0, 9.0, 3.5])
    row = spark.createDataFrame(pd.DataFrame({"x": v})).agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(v.skew()) and row[1] == pytest.approx(v.kurt())


def test_codes_and_quarters(spark):
    df = spark.createDataFrame([("1",), ("000021",), ("600000",), ("AB1",), (None,)], "s string")
    assert [r[0] for r in df.select(symbol_code(F.col("s"))).collect()] == ["000001", "000021", "600000", "AB1", None]
    assert spark.range(1).select(quarter_end(F.lit(dt.date(2024, 8, 31)))).first()[0] == dt.date(2024, 9, 30)


def test_grid_and_fills(spark):
    p = make(spark, [(0, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0)])
    d = grid.densify(p).withColumns({"f": grid.ffill(F.col("x")), "b": grid.bfill(F.col("x")), "l": grid.lag(F.col("x"), 1)})
    assert got(d, "f") == [1.0, 1.0, 3.0] and got(d, "b") == [1.0, 3.0, 3.0] and got(d, "l") == [None, 1.0, None]
    assert got(d, "f", "b") == [None, 5.0, 5.0]


def test_bfill_is_a_running_frame(spark, capsys):
    """A frame from a row to the partition's end takes a symbol's rows squared."""
    p = make(spark, [(i, s, float(i) if i % 7 == 3 else None) for i in range(60) for s in "ab"])
    d = p.withColumn("b", grid.bfill(F.col("x")))
    d.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out
    assert got(d, "b") == [float(i + (3 - i) % 7) for i in range(60)]


def test_asof_takes_reports_of_idle_days(spark):
    days, assets = make(spark, [(0, "a", 0.0), (3, "a", 0.0), (5, "a", 0.0)]), spark.createDataFrame([("a",), ("b",)], "symbol string")
    reports = make(spark, [(1, "a", 7.0), (3, "a", None), (9, "a", 8.0)])
    assert got(grid.asof(reports, days, assets, ["x"]), "x") == [None, 7.0, 7.0]
    assert got(grid.asof(reports, days, assets, ["x"], True), "x", "b") == [0.0, 0.0, 0.0]


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(3)
    v = pd.Series(np.where(rng.random(60) < 0.25, np.nan, rng.normal(size=60)))
    p = make(spark, [(i, "a", None if math.isnan(x) else float(x)) for i, x in enumerate(v)])
    x, r = F.col("x"), F.col("i")
    made = p.withColumns({
        "mean": series.ts_mean(x, 5, 2), "std": series.ts_stddev(x, 10), "rank": series.ts_rank(x, 6, 3), "prod": series.ts_prod(x, 4, 1),
        "hi": series.ts_max(x, 5), "at": series.ts_argmax(x, 5, r, 1), "low": series.ts_argmin(x, 5, r, 1),
    })

    def same(c, want):
        a = np.array([np.nan if y is None else y for y in got(made, c)], float)
        np.testing.assert_allclose(a, np.asarray(want, float), rtol=1e-9, equal_nan=True)

    same("mean", v.rolling(5, 2).mean())
    same("std", v.rolling(10, 2).std())
    same("rank", v.rolling(6, 3).rank())
    same("prod", v.rolling(4, 1).apply(np.nanprod))
    hi = v.rolling(5, 1).max()
    hi[:4] = np.nan
    same("hi", hi)
    same("at", [np.nan if v[max(0, t - 4) : t + 1].isna().all() else v[max(0, t - 4) : t + 1].idxmax() + 1 for t in range(60)])
    same("low", [np.nan if v[max(0, t - 4) : t + 1].isna().all() else v[max(0, t - 4) : t + 1].idxmin() + 1 for t in range(60)])


def test_recursions_against_loops(spark):
    rng = np.random.default_rng(5)
    v = np.where(rng.random(80) < 0.2, np.nan, rng.normal(10, 1, 80))
    p = make(spark, [(i, "a", None if math.isnan(x) else float(x)) for i, x in enumerate(v)])

    alpha, y, weight, want = 2 / 6, math.nan, 1.0, []
    for x in v:  # weights of the past shrink over gaps as well
        if math.isnan(y):
            y = x
        else:
            weight *= 1 - alpha
            if not math.isnan(x):
                y = (weight * y + alpha * x) / (weight + alpha)
                weight = 1.0
        want.append(y)
    out = got(recursive.ewm_mean(p, "x", 5, 1), "ewm_mean")
    np.testing.assert_allclose(np.array(out, float), want, rtol=1e-9)

    known, n = v[~np.isnan(v)], 14
    up = np.maximum(np.diff(known), 0)
    down = np.maximum(-np.diff(known), 0)
    a, b, rsi = up[:n].mean(), down[:n].mean(), []
    for k in range(n, len(known)):
        if k > n:
            a, b = (a * (n - 1) + up[k - 1]) / n, (b * (n - 1) + down[k - 1]) / n
        rsi.append(100 * a / (a + b))
    out = [x for x in got(recursive.rsi(p, "x", n), "rsi") if x is not None]
    np.testing.assert_allclose(out, rsi, rtol=1e-9)


def test_ts_corr_is_zero_at_the_head(spark):
    p = make(spark, [(i, "a", float(x), float(y)) for i, (x, y) in enumerate([(1, 4), (2, 3), (3, 2), (4, 1)])], "i int, symbol string, x double, y double")
    assert got(recursive.ts_corr(p, "x", "y", 3), "ts_corr") == [0.0, 0.0, -1.0, -1.0]


def test_intangible_assets_follow_reports(spark):
    rows = [(0, "a", 0.0, 0.0, 0.0, 9.0), (1, "a", 5.0, 2.0, 3.0, 9.0), (2, "a", 5.0, 2.0, 3.0, 9.0), (3, "a", 6.0, 2.0, 3.0, 9.0)]
    p = make(spark, rows, "i int, symbol string, d double, s double, m double, g double")
    p = p.withColumns({f"{c}_1": F.lit(1.0) for c in "dsmg"})
    out = got(recursive.intangible_assets(p, "d", "s", "m", "g"), "intangible")
    # Goodwill starts the stocks on day 0; costs then flow into them.
    assert out[0] == 9.0 and out[1] == pytest.approx(5 + 5 * 0.3) and out[2] == out[1]
    assert out[3] == pytest.approx(5 * 0.7 + 6 + 1.5)


def test_cross_section(spark):
    p = make(spark, [(0, "a", 1.0), (0, "b", 3.0), (0, "c", 3.0), (0, "d", None), (1, "a", None), (1, "b", None), (2, "a", 2.0)])
    x = F.col("x")
    out = p.withColumns({"r": panel.panel_rank(x), "v": panel.average_rank(x), "z": panel.normalize(x), "b": panel.panel_binning(x, 2), "t": panel.top_share(x, 0.5)})
    first = {r["symbol"]: r for r in out.filter("i = 0").collect()}
    assert [first[s]["r"] for s in "abcd"] == [0, 1, 2, None]
    assert [first[s]["v"] for s in "abcd"] == [1.0, 2.5, 2.5, None]
    assert [first[s]["b"] for s in "abcd"] == [1, 2, 2, None]
    assert [first[s]["t"] for s in "abcd"] == [None, 1, 1, None]
    assert all(r["z"] is None for r in out.filter("i > 0").collect())  # no value, or a single one


def test_residual_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [(d, f"s{k}", float(a), float(a * 2 + b)) for d in range(3) for k, (a, b) in enumerate(rng.normal(size=(20, 2)))]
    p = make(spark, rows, "i int, symbol string, x double, y double").withColumn("e", panel.panel_reg_residual(F.col("y"), F.col("x")))
    for r in p.groupBy("i").agg(F.avg("e").alias("m"), F.covar_pop("e", "x").alias("c")).collect():
        assert abs(r["m"]) < 1e-12 and abs(r["c"]) < 1e-12


def test_winsorize_and_clean(spark):
    p = make(spark, [(0, f"s{k}", float(v)) for k, v in enumerate([1, 2, 3, 4, 1000])])
    assert max(r["x"] for r in panel.with_winsorized(p, "x").collect()) == 8.0
    p = make(spark, [(0, "a", 0.0), (0, "b", float("nan")), (0, "c", 1.0), (0, "d", 3.0)])
    out = {r["symbol"]: r["x"] for r in panel.with_cleaned(p, "x").collect()}
    assert out["a"] is None and out["b"] is None and out["c"] == pytest.approx(-1) and out["d"] == pytest.approx(1)


def reports(spark):
    rows = [("1", "20230331", "20230420", 10.0), ("1", "20230930", "20240115", 40.0), ("1", "20231231", "20240401", 70.0), ("1", "20240331", "20240415", 20.0)]
    return spark.createDataFrame(rows, "SYMBOL string, ENDDATE string, PUBLISHDATE string, v double")


def test_financials(spark):
    full = financials.preprocess(reports(spark)).orderBy("enddate").collect()
    assert [str(r["enddate"]) for r in full] == ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31", "2024-03-31"]
    assert [str(r["publishdate"]) for r in full] == ["2023-04-20", "2023-08-30", "2023-10-30", "2024-04-01", "2024-04-15"]
    q = financials.to_single_quarter(financials.preprocess(reports(spark)), ["v"]).orderBy("enddate").collect()
    assert [r["v_mrq"] for r in q] == [10.0, None, None, 30.0, 20.0]
    t = financials.to_trailing_year(financials.preprocess(reports(spark)), ["v"]).orderBy("enddate").collect()
    assert [r["v_ttm"] for r in t] == [40.0, None, pytest.approx(40 * 4 / 3), 70.0, 80.0]
    with pytest.raises(ValueError):
        financials.validate_cell(financials.preprocess(reports(spark)), "000001", "2023-03-31", "v", 11.0)


def test_members_ends(spark):
    days = make(spark, [(i, "a", 0.0) for i in range(5)])
    spans = spark.createDataFrame([("a", DAY + dt.timedelta(1), DAY + dt.timedelta(3)), ("b", None, None)], "symbol string, lo date, hi date")
    assert universe.members(spans, days, "lo", "hi", True).count() == 3
    assert universe.members(spans, days, "lo", "hi", False).count() == 2


def test_overwrite_merge_prefers_new(spark):
    old, new = make(spark, [(0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0)]), make(spark, [(1, "a", 9.0), (1, "b", 8.0)])
    rows = landing.overwrite_merge(old.drop("i"), new.drop("i")).orderBy("tradedate", "symbol").collect()
    assert [(r["symbol"], r["x"]) for r in rows] == [("a", 1.0), ("a", 9.0), ("b", 8.0)]
    assert landing.overwrite_merge(old.drop("i"), new.drop("i").limit(0)).count() == 3


def test_landing_formats(spark, tmp_path):
    rows = [("1", "20240102", float("nan"), 1.0), ("1", "20240102", 2.0, 0.5), (None, "20240102", 1.0, 1.0), ("x", "bad", 1.0, 1.0)]
    out = {(r["symbol"], str(r["tradedate"])): r["v"] for r in landing.format_table(spark.createDataFrame(rows, "SYMBOL string, TradeDate string, v double, w double")).collect()}
    assert set(out) == {("000001", "2024-01-02"), ("x", "None")}
    landing.save_factor(make(spark, [(0, "a", 1.0)]).withColumnRenamed("x", "value"), str(tmp_path), "one")
    assert landing.load_factors(spark, str(tmp_path)).first()["factor"] == "one"
    assert landing.full_query("select 1 where d >= '{}'").endswith("'19000101'")
    assert landing.incremental_query("{}", "20240131") == "20240101"


def test_backtest_fee_and_drawdown(spark):
    rows = [(0, "a", 1.0, 0.1), (0, "b", 2.0, 0.2), (40, "a", 2.0, -0.5), (40, "b", 1.0, 0.0)]
    cells = make(spark, rows, "i int, symbol string, factor double, fwd double")
    cells = backtest.binned(cells, 2)
    free = {(r["tradedate"], r["bin"]): r["ret"] for r in backtest.group_returns(cells).collect()}
    paid = {(r["tradedate"], r["bin"]): r["ret"] for r in backtest.group_returns(cells, 0.01).collect()}
    later = DAY + dt.timedelta(40)
    assert free[later, 2] == -0.5 and paid[later, 2] == pytest.approx(-0.51) and paid[DAY, 2] == free[DAY, 2]
    down = backtest.drawdown(backtest.sides(backtest.group_returns(cells), 2)).orderBy("tradedate").collect()
    assert down[1]["drawdown"] == pytest.approx(-0.5)


def test_merge_stream(spark, tmp_path):
    from panelspark.sources.keyed import KeyedTable
    from panelspark.streaming.incremental import merge_stream

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = make(spark, [(0, "a", 1.0), (1, "a", 2.0)]).drop("i")
    first.write.parquet(f"{src}/1")
    for k, rows in enumerate([None, [(1, "a", 5.0)]]):
        if rows:
            make(spark, rows).drop("i").write.mode("append").parquet(f"{src}/2")
        stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(src)
        merge_stream(stream, target, str(tmp_path / "check")).awaitTermination(60)
        last = KeyedTable(spark, target).read(k + 1)
    assert sorted(r["x"] for r in last.collect()) == [1.0, 5.0]


def test_last_view_makes_the_factor_once(spark, capsys):
    """Within a pool the last day is that of a known value of the pool; the factor is not made again to find it."""
    day = F.date_add(F.lit(DAY), F.floor(F.col("id") / 3).cast("int"))
    factor = spark.range(12).select(day.alias("tradedate"), F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), F.when(F.col("id") < 10, F.col("id").cast("double")).alias("value"))
    pool = factor.filter("symbol != 's0'").select("tradedate", "symbol")
    view = backtest.last_factor_view(factor, pool)
    view.explain()
    assert "Range (" not in capsys.readouterr().out
    got_ = sorted((r["tradedate"], r["symbol"], r["value"], r["pct"]) for r in view.collect())
    assert got_ == [(DAY + dt.timedelta(2), "s1", 7.0, 0.5), (DAY + dt.timedelta(2), "s2", 8.0, 1.0)]


def test_average_rank_takes_one_sort(spark, capsys):
    p = make(spark, [(0, s, x) for s, x in zip("abcdefgh", (2.0, None, 1.0, 2.0, 0.0, -0.0, None, 2.0), strict=True)])
    out = p.withColumn("r", panel.average_rank(F.col("x")))
    out.explain()
    assert capsys.readouterr().out.count("Sort [") == 1
    assert {r["symbol"]: r["r"] for r in out.collect()} == {"a": 5.0, "b": None, "c": 3.0, "d": 5.0, "e": 1.5, "f": 1.5, "g": None, "h": 5.0}
