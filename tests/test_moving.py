"""Moving sums, extremes, decays and regressions against direct loops, and factors against cells worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import moving
from panelspark.plans import stock_factors as sf

DAY = dt.date(1900, 1, 1)


def frame(spark, **columns):
    names = list(columns)
    rows = [(i, "a", *(None if isinstance(v, float) and math.isnan(v) else v for v in values)) for i, values in enumerate(zip(*columns.values(), strict=True))]
    rows += [(i, "b", *(0.0 for _ in names)) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, symbol string, " + ", ".join(f"{c} double" for c in names))
    return df.withColumn("tradedate", F.date_add(F.lit(DAY), F.col("i")))


def got(df, *names):
    rows = df.filter("symbol = 'a'").orderBy("i").select(*names).collect()
    return [np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in names]


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(7)
    x, y = r.normal(size=90), r.normal(size=90)
    x[r.random(90) < 0.2] = np.nan
    return x.tolist(), y.tolist()


@pytest.mark.parametrize("n", [1, 7, 30, 200])
def test_sums_extremes_and_decay(spark, values, n):
    x = np.array(values[0])
    df = moving.moving_sums(frame(spark, x=values[0]), n, s=F.col("x"))
    df = moving.moving_extremes(df, n, F.col("x"), "lo", "hi")
    df = moving.decay(moving.decay(df, "d", F.col("x"), n, 3.0, "sum", 1), "e", F.col("x"), n, 3.0, "std", 1)
    total, low, high, summed, spread = got(df, "s", "lo", "hi", "d", "e")
    for t in range(len(x)):
        w = x[max(0, t - n + 1) : t + 1]
        w = w[~np.isnan(w)]
        assert total[t] == pytest.approx(w.sum(), abs=1e-12)
        if not len(w):
            assert np.isnan([low[t], high[t], summed[t], spread[t]]).all()
            continue
        assert (low[t], high[t]) == (w.min(), w.max())
        decayed = w * 0.5 ** (np.arange(len(w))[::-1] / 3.0)
        assert summed[t] == pytest.approx(decayed.sum(), abs=1e-12) and spread[t] == pytest.approx(decayed.std(), abs=1e-9)


def test_an_outlier_leaves_no_trace(spark):
    x = [1e15] + [0.1] * 60
    total = got(moving.moving_sums(frame(spark, x=x), 10, s=F.col("x")), "s")[0]
    assert total[25] == pytest.approx(1.0, rel=1e-14)


def test_regression_equals_least_squares(spark, values):
    x, y = np.nan_to_num(np.array(values[0])), np.array(values[1]) + 1e4
    df = moving.moving_regression(frame(spark, x=values[0], y=y.tolist()), 20, F.col("y"), F.col("x"), "b", "a")
    b, a = got(df, "b", "a")
    assert np.isnan(b[:19]).all()
    for t in range(19, 90):
        want = np.polyfit(x[t - 19 : t + 1], y[t - 19 : t + 1], 1)
        assert b[t] == pytest.approx(want[0], rel=1e-7, abs=1e-9) and a[t] == pytest.approx(want[1], rel=1e-9)


def test_beta_equals_weighted_least_squares(spark):
    r = np.random.default_rng(3)
    bm, ret = r.normal(size=400) / 100, r.normal(size=400) / 50
    ret[[0, 330]] = np.nan
    df = sf._regression(frame(spark, ret=ret.tolist(), bm_ret=bm.tolist()), 60, 15.0)
    b, a, h = got(df, "beta_raw", "halpha", "hsigma")
    excess = ret - bm
    for t in range(400):
        y, x = excess[max(0, t - 59) : t + 1], bm[max(0, t - 59) : t + 1]
        if len(y) < 60 or np.isnan(y).any():
            assert np.isnan(b[t])
            continue
        w = np.sqrt(0.5 ** (np.arange(60)[::-1] / 15.0))
        want = np.linalg.lstsq(np.column_stack([w, w * x]), w * y, rcond=None)[0]
        assert (a[t], b[t]) == pytest.approx(tuple(want), rel=1e-7, abs=1e-10)
        assert h[t] == pytest.approx((y - want[1] * x).std(), rel=1e-7)


def test_long_series_stay_finite(spark):
    n = 100_000
    df = spark.range(n).selectExpr("cast(id as int) AS i", "'a' AS symbol", "sin(id) AS ret", "cos(id * 0.7) AS bm_ret").withColumn("tradedate", F.timestamp_seconds("i"))
    df = sf.dastd(sf._regression(df))
    last = df.agg(F.count("beta_raw"), F.count_if(F.abs("beta_raw") < 10), F.max("hsigma"), F.count("dastd"), F.max("dastd")).first()
    assert last[0] == last[1] == n - 251 and last[2] < 10 and last[3] == n - 119 and 0 < last[4] < 10


CELL = {
    "px": 10.0, "negotiablemv": 800.0, "totmktcap": 1000.0, "stk_share": 50.0, "pe_fcst": 8.0, "turnrate": 2.0, "net_revenue_fcst": 30.0, "net_revenue_fcst_2": 24.0,
    "parenetp_ttm": 200_000.0, "parenetp": 50_000.0, "mananetr_ttm": 300_000.0, "mananetr": 60_000.0, "bizinco": 900_000.0, "bizinco_ttm": 2_000_000.0, "bizcost": 600_000.0,
    "mainbizinco": 800_000.0, "mainbizcost": 500_000.0, "paresharrigh": 4_000_000.0, "prest": 100_000.0, "perbond": 50_000.0, "righaggr": 5_000_000.0, "totliab": 6_000_000.0,
    "totasset": 10_000_000.0, "totalnoncliab": 2_000_000.0, "totcurrasset": 3_000_000.0, "totalcurrliab": 1_500_000.0,
} | {f"paresharrigh_{i}": 4_000_000.0 - 400_000 * i for i in (1, 2, 3)} | {f"totasset_{i}": 8_000_000.0 for i in (1, 2, 3)}

#: Worked out by hand from the definitions.
WANT = {
    "lncap": math.log(800), "btop": 3_850_000 / 1e7, "bp": 3_850_000 / 1e7, "epfwd": 0.125, "ep": 0.02, "cp": 0.03, "egrsf": 24 / 20 - 1, "egrlf": 30 / 20 - 1,
    "mlev": (1000 + 10 + 200) / 1000, "blev": (490 + 10 + 200) / 490, "dtoa": 0.6, "roe": 50_000 / 3_400_000, "roa": 50_000 / 8_500_000, "margin_rate": 1 / 3, "main_margin_rate": 0.375,
    "turnover_rate": 900_000 / 8_500_000, "debt_to_asset": 0.6, "current_ratio": 2.0,
}


def test_factor_cells(spark):
    df = frame(spark, **{c: [v, v] for c, v in CELL.items()})
    row = sf.need(df, *[sf.STOCK_FACTORS[c] for c in WANT]).filter("symbol = 'a' and i = 1").first()
    assert {c: row[c] for c in WANT} == pytest.approx(WANT)
    row = df.transform(sf.roe, True, False).transform(sf.roa, False, False).transform(sf.turnover_rate, True, True).filter("symbol = 'a' and i = 1").first()
    assert (row["roe"], row["roa"], row["turnover_rate"]) == pytest.approx((0.05, 0.005, 2 / 8.5))


def test_factor_changes(spark):
    """F-score, yearly changes and the month range on two days a year apart, or on known returns."""
    now = CELL | {"parenetp": 55_000.0, "totliab": 5_900_000.0, "bizinco": 990_000.0}
    df = frame(spark, **{c: [v, now[c]] for c, v in CELL.items()})
    row = sf.fscore(df, 1).filter("symbol = 'a' and i = 1").first()
    # Every signal but a change of the current ratio is up; an equal current ratio counts.
    assert row["fscore"] == 8
    worse = frame(spark, **{c: [now[c], v] for c, v in CELL.items()})
    assert sf.fscore(worse, 1).filter("symbol = 'a' and i = 1").first()["fscore"] == 4
    assert sf.roe_yoy_real(df, 1).filter("symbol = 'a' and i = 1").first()["roe_yoy_real"] == pytest.approx(math.log(1.1))
    ret = [math.nan, *([0.01] * 20), *([0.02] * 21)]
    flat = frame(spark, ret=ret, bm_ret=[0.005] * 42)
    first, second = 20 * 0.005, 21 * 0.015
    assert sf.cmra(flat, 2).filter("symbol = 'a' and i = 41").first()["cmra"] == pytest.approx(math.log(1 + second) - math.log(1 + first))


def test_weights_of_mixes(spark):
    rows = [(f"s{k}", float(k), float(k * k % 7), float(k * 3 % 5)) for k in range(9)]
    df = spark.createDataFrame(rows, "symbol string, epfwd double, cp double, ep double").withColumn("tradedate", F.lit(DAY))
    values = {r["symbol"]: r["earnings"] for r in sf.earnings(df).collect()}
    raw = np.array([0.68 * e + 0.21 * c + 0.11 * p for _, e, c, p in rows])
    middle = np.median(raw)
    held = np.clip(raw, middle - 5 * np.median(abs(raw - middle)), middle + 5 * np.median(abs(raw - middle)))
    want = (held - held.mean()) / held.std(ddof=1)
    assert [values[f"s{k}"] for k in range(9)] == pytest.approx(want.tolist())


def test_growth_is_by_running_frames(spark, capsys):
    """A frame from a row to the partition's end takes a symbol's rows squared; both fields share the sort of one."""
    n = 1100
    x = [0.0 if i % 5 else 10.0 + i * i % 97 for i in range(n)]
    df = sf.need(frame(spark, bizinco_ttm=x, parenetp_ttm=[2 * v - 3 for v in x], stk_share=[4.0] * n), sf.egrow, sf.npgrow)
    df.explain()
    plan = capsys.readouterr().out
    assert "unboundedfollowing" not in plan and plan.count("Sort [") == 1
    v = [next((y / 4 for y in x[i:] if y), None) for i in range(n)]
    w = [(2 * y - 3) / 4 for y in x]
    want = [((z[-1] - z[0]) / 2 / (sum(z) / 3)) if None not in z else None for z in ((c[n - 505], c[n - 253], c[n - 1]) for c in (v, w))]
    got = df.filter(f"i = {n - 1}").first()
    assert [got["egrow"], got["npgrow"]] == [y if y is None else pytest.approx(y) for y in want]
    early = df.filter("i = 600").first()
    assert early["egrow"] == pytest.approx((v[600] - v[96]) / 2 / ((v[600] + v[348] + v[96]) / 3))
    assert df.filter("i = 503").first()["egrow"] is None


@pytest.mark.parametrize("n", [2, 7, 20])
def test_correlation_equals_direct_frames(spark, values, n, capsys):
    """A row's cost does not grow with n; equal values have no correlation, even such as rounding moves in a mean."""
    x, y = [list(v) for v in values]
    x[40:70], y[55:80] = [0.1] * 30, [1e6 + 0.3] * 25
    for i in (9, 10, 11, 12):
        x[i], y[i] = 1e3 + 1e-3 * (i % 2), 0.7 * i
    df = moving.moving_correlation(frame(spark, x=x, y=y), n, F.col("x"), F.col("y"), "r")
    df.explain()
    assert f"RowFrame, -{n - 1}, currentrow" not in capsys.readouterr().out
    want = []
    for i in range(90):
        a, b = np.array(x[max(i + 1 - n, 0) : i + 1]), np.array(y[max(i + 1 - n, 0) : i + 1])
        flat = len(a) < n or np.isnan(a + b).any() or len(set(a)) == 1 or len(set(b)) == 1
        want.append(np.nan if flat else np.corrcoef(a, b)[0, 1])
    np.testing.assert_allclose(got(df, "r")[0], want, rtol=1e-7, atol=1e-9, equal_nan=True)


def test_residual_volatility_sums_its_frames_at_once(spark, capsys):
    r = np.random.default_rng(9)
    n = 300
    ret, bm = (r.normal(size=n) / 50 for _ in "ab")
    ret[r.random(n) < 0.1] = np.nan
    df = frame(spark, ret=ret.tolist(), bm_ret=bm.tolist())
    made = sf.residual_volatility(df)
    made.explain()
    plan = capsys.readouterr().out
    # By symbol and day, by block and day, by day.
    assert plan.count("Sort [") == 3 and "RowFrame, -20, currentrow" not in plan
    one = got(made, "dastd", "cmra", "hsigma")
    for a, b in zip(one, (got(step(df), step.__name__)[0] for step in (sf.dastd, sf.cmra, sf.hsigma)), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12, equal_nan=True)
    excess = np.nan_to_num(ret - bm)
    months = [excess[i + 1 - 21 : i + 1].sum() for i in range(280, 0, -21)][:12]
    assert one[1][280] == pytest.approx(math.log(1 + max(months)) - math.log(1 + min(months)))
    assert np.isnan(one[1][250]) and not np.isnan(one[1][251])


@pytest.mark.parametrize("n", [1, 7, 30])
def test_totals_of_zeros_are_zero(spark, n, capsys):
    """Sums by adding only: nothing is left of large values that were in the frame before."""
    x = [0.1 * 3**i if i < 20 else math.nan if i % 11 == 0 else 0.0 if i < 60 else 0.3 for i in range(90)]
    out = moving.moving_totals(frame(spark, x=x), n, s=F.col("x"), a=F.abs(F.col("x")), k=F.col("x").isNotNull().cast("double"))
    out.explain()
    assert n == 1 or f"RowFrame, -{n - 1}, currentrow" not in capsys.readouterr().out
    s, a, k = got(out, "s", "a", "k")
    v = np.array(x)
    np.testing.assert_allclose(s, [np.nansum(v[max(i + 1 - n, 0) : i + 1]) for i in range(90)], rtol=1e-12)
    assert (s == a).all() and k.tolist() == [float((~np.isnan(v[max(i + 1 - n, 0) : i + 1])).sum()) for i in range(90)]
    assert s[59] == 0.0
