"""Recurrences, order statistics and moments of long frames against brute force and pandas."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import moving, panel, recursive, scan

DAY = dt.date(2010, 1, 1)


def series(spark, **columns):
    """Two symbols, the second a shifted copy of the first, so that nothing runs across symbols."""
    n = len(next(iter(columns.values())))
    rows = [(s, i, *[None if v[k] is None or v[k] != v[k] else float(v[k]) for v in columns.values()]) for s in "ab" for i in range(n) for k in [i if s == "a" else (i + 7) % n]]
    df = spark.createDataFrame(rows, f"symbol string, i int, {', '.join(f'{c} double' for c in columns)}")
    return df.withColumn("tradedate", F.date_add(F.lit(DAY), F.col("i"))).repartition(3)


def values(df, c, symbol="a"):
    return np.array([np.nan if r[c] is None else r[c] for r in df.filter(F.col("symbol") == symbol).orderBy("tradedate").collect()])


def noisy(n, seed, share=0.2):
    g = np.random.default_rng(seed)
    v = g.normal(size=n).cumsum() + 50
    return np.where(g.random(n) < share, np.nan, v)


def test_affine_scan_equals_a_loop(spark):
    g = np.random.default_rng(2)
    c = g.choice([0.0, 1.0, 0.5, 0.9, 1e-9, 1e-300], 900, p=[0.02, 0.3, 0.3, 0.3, 0.07, 0.01])
    d = g.normal(size=900)
    y, want = 0.0, []
    for k in range(900):
        y = c[k] * y + d[k]
        want.append(y)
    out = scan.affine_scan(series(spark, c=c, d=d), F.col("c"), y=F.col("d"), z=-F.col("d"))
    np.testing.assert_allclose(values(out, "y"), want, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(values(out, "z"), -np.array(want), rtol=1e-9, atol=1e-9)


def test_scans_of_several_factors_share_a_pass(spark, capsys):
    g = np.random.default_rng(4)
    c, e = (g.choice([0.0, 1.0, 0.7, 1e-150], 400, p=[0.02, 0.6, 0.36, 0.02]) for _ in "ab")
    d = g.normal(size=400)
    df = series(spark, c=c, e=e, d=d)
    out = scan.affine_scans(df, (F.col("c"), {"y": F.col("d")}), (F.col("e"), {"z": F.col("d")}))
    out.explain()
    assert capsys.readouterr().out.count("Sort [") == 2  # by day, by block and day
    for name, a in (("y", c), ("z", e)):
        want, v = [], 0.0
        for k in range(400):
            v = a[k] * v + d[k]
            want.append(v)
        np.testing.assert_allclose(values(out, name), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("span", [1, 3, 120])
def test_ewm_equals_pandas(spark, span, adjust):
    v = noisy(1500, span)
    v[:4] = np.nan
    v[700:900] = np.nan
    out = scan.ewm_mean(series(spark, x=v), "x", span, 2, adjust)
    for s, x in (("a", v), ("b", np.roll(v, -7))):
        want = pd.Series(x).ewm(span=span, adjust=adjust, min_periods=2).mean().to_numpy()
        np.testing.assert_allclose(values(out, "ewm_mean", s), want, rtol=1e-9)


def test_no_python_in_scans(spark):
    df = series(spark, x=noisy(20, 1))
    for out in (scan.ewm_mean(df, "x", 5), scan.rsi(df, "x", 5), recursive.rolling_ols_std(df, "x", "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_intangible_assets_equal_a_loop(spark):
    """Every expense moves alone and together, goodwill too, and some reports come in April."""
    g = np.random.default_rng(7)
    n = 500
    v = np.zeros((n, 4))
    for t in range(10, n):
        v[t] = v[t - 1]
        if g.random() < 0.1:
            moved = g.random(4) < 0.5
            v[t, moved] = g.integers(0, 9, moved.sum())
    before = g.integers(0, 5, (n, 4)).astype(float)
    know = org = good = 0.0
    on, want = False, []
    for t in range(n):
        if not on and v[t].any():
            on, know, org, good = True, v[t, 0] / 0.5, (v[t, 1] + v[t, 2]) * 0.3 / 0.5, v[t, 3]
        elif on:
            m = v[t] != v[t - 1]
            extra = before[t] if (DAY + dt.timedelta(t)).month == 4 else np.zeros(4)
            know = know * 0.7 + v[t, 0] + extra[0] if m[0] else know
            org = org * 0.7 + (v[t, 1] + v[t, 2] + extra[1] + extra[2]) * 0.3 if m[1] and m[2] else org
            good = v[t, 3] + extra[3] if m[3] else good
        want.append((know + org if know + org > 0 else good) if on else 0.0)
    cols = {c: [x or None for x in v[:, j]] for j, c in enumerate("dsmg")} | {f"{c}_1": before[:, j] for j, c in enumerate("dsmg")}
    out = scan.intangible_assets(series(spark, **cols), "d", "s", "m", "g")
    np.testing.assert_allclose(values(out, "intangible"), want, rtol=1e-9, atol=1e-12)
    alone = [v[t] != v[t - 1] for t in range(12, n)]
    assert all(any(m.sum() == 1 and m[j] for m in alone) for j in range(4))


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400])
def test_rank_pct_equals_brute_force(n):
    g = np.random.default_rng(n)
    v = np.where(g.random(300) < 0.15, np.nan, g.integers(0, 25, 300) / 3)
    got = recursive.rank_pct(v, n, max(1, n // 2))
    for t in range(300):
        w = v[max(0, t + 1 - n) : t + 1]
        w = w[~np.isnan(w)]
        ok = not np.isnan(v[t]) and len(w) >= max(1, n // 2)
        want = ((w < v[t]).sum() + ((w == v[t]).sum() + 1) / 2) / len(w) if ok else np.nan
        assert got[t] == pytest.approx(want, nan_ok=True)
    assert np.isnan(recursive.rank_pct(np.full(5, np.nan), n, 1)).all() and len(recursive.rank_pct(np.empty(0), n, 1)) == 0


def test_rank_pct_does_not_slow_with_the_frame():
    v = np.random.default_rng(1).normal(size=50_000)

    def seconds(n):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            recursive.rank_pct(v, n, n)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(2500) < 2 * seconds(250)


@pytest.mark.parametrize("n", [2, 5, 20, 90])
def test_spearman_equals_pandas(n):
    g = np.random.default_rng(n)
    x, y = g.integers(0, 12, 260).astype(float), g.normal(size=260).round(1)
    x[40], y[100] = np.nan, np.nan
    x[150 : 150 + n + 3] = 4.0  # equal values have no correlation
    got = recursive.spearman(x, y, n)
    for t in range(260):
        a, b = pd.Series(x[max(0, t + 1 - n) : t + 1]), pd.Series(y[max(0, t + 1 - n) : t + 1])
        whole = len(a) == n and not a.isna().any() and not b.isna().any() and a.nunique() > 1 and b.nunique() > 1
        want = a.rank().corr(b.rank()) if whole else np.nan
        assert got[t] == pytest.approx(want, abs=1e-12, nan_ok=True)


@pytest.mark.parametrize("n", [2, 5, 30, 252])
def test_moments_equal_pandas(spark, n):
    # A large level beside a small spread: sums of squares would lose the deviation.
    v = noisy(600, n) * 1e-3 + 1e6
    v[300:340] = 1e6
    out = moving.moving_moments(series(spark, x=v), n, x=F.col("x"))
    for s, x in (("a", pd.Series(v)), ("b", pd.Series(np.roll(v, -7)))):
        w = x.rolling(n, min_periods=1)
        want = x.to_frame("x").rolling(n, min_periods=1).apply(lambda a: np.std(a[~np.isnan(a)], ddof=1) if (~np.isnan(a)).sum() > 1 else np.nan, raw=True)["x"]
        np.testing.assert_allclose(values(out, "x_n", s), w.count().fillna(0))
        np.testing.assert_allclose(values(out, "x_mean", s), w.mean(), rtol=1e-12)
        np.testing.assert_allclose(values(out, "x_std", s), want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("most", [50, 10_000])
def test_order_statistics_take_bounded_tasks(spark, most):
    g = np.random.default_rng(3)
    cols = {"u": g.normal(size=20_000), "v": g.integers(0, 3, 20_000).astype(float), "w": np.where(g.random(20_000) < 0.5, 7.0, g.normal(size=20_000))}
    df = spark.createDataFrame(pd.DataFrame(cols)).repartition(4)
    got = panel.quantiles(df, list(cols), (0.25, 0.5, 0.75), most)
    for c, x in cols.items():
        assert got[c] == pytest.approx(np.percentile(x, [25, 50, 75]), rel=1e-12, abs=1e-15)
    # Ranks at the edge of two values that repeat; a table without values.
    two = spark.createDataFrame(pd.DataFrame({"x": [1.0] * 4000 + [2.0] * 6000})).repartition(4)
    assert panel.quantiles(two, ["x"], (0.4, 0.3999, 0.41), most)["x"] == pytest.approx(np.percentile([1.0] * 4000 + [2.0] * 6000, [40, 39.99, 41]))
    assert panel.quantiles(two.limit(0), ["x"], (0.5,), most) == {"x": [None]}
