"""Sums and extremes of long frames in a bounded number of steps a row, whatever the length of the frame.

Rows of a symbol are cut into blocks of the frame's length. A frame of n rows is the current block up to the
current row and the previous block from where the frame begins, so a sum is a running sum plus what is left of
the previous block's, and an extreme is one of a running extreme and one that runs backwards. A value leaves the
sums with its block, so rounding does not build up over a long series.

df needs i, the row of the symbol's grid from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import by_symbol, so_far

_BLOCK = "_block"


def _blocked(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(F.col("i") / n))


def _block() -> WindowSpec:
    return W.partitionBy("symbol", _BLOCK)


def _upto(backwards: bool = False) -> WindowSpec:
    at = F.desc("tradedate") if backwards else F.asc("tradedate")
    return _block().orderBy(at).rowsBetween(W.unboundedPreceding, 0)


def _earlier(c: str, n: int) -> Column:
    # Ordered by block first, as the block's own frames are, so one sort serves both.
    return F.lag(c, n).over(W.partitionBy("symbol").orderBy(_BLOCK, "tradedate"))


@dataclass(frozen=True)
class Sums:
    """Terms that are summed alike: each of its own weight, or weighted by 2^(-steps / half_life).

    Steps are of the column k, a count that does not fall down the rows (grid rows, or known values so far).
    """

    terms: dict[str, Column]
    k: str | None = None
    half_life: float = 1.0


def frame_sums(df: DataFrame, n: int, *parts: Sums) -> DataFrame:
    """Adds the sum of each term of each part over the last n rows of the symbol; unknown terms count as zero.

    All parts share one sort and three passes. Weights are relative to their own block, so that they stay in range
    however long the series is.
    """
    steps = list(dict.fromkeys(p.k for p in parts if p.k is not None))
    names = [c for p in parts for c in p.terms]
    df = _blocked(df, n)
    whole = _block().orderBy("tradedate").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({f"_k0_{k}": F.min(F.col(k).cast("double")).over(whole) for k in steps})

    def weight(p: Sums, base: str, sign: int) -> Column:
        return F.pow(F.lit(2.0), sign * (F.col(p.k).cast("double") - F.col(f"{base}_{p.k}")) / p.half_life)

    df = df.withColumns({f"_t_{c}": F.coalesce(x.cast("double") if p.k is None else x.cast("double") * weight(p, "_k0", 1), F.lit(0.0)) for p in parts for c, x in p.terms.items()})
    df = df.withColumns({f"_u_{c}": F.sum(f"_t_{c}").over(_upto()) for c in names} | {f"_w_{c}": F.sum(f"_t_{c}").over(whole) for c in names})
    df = df.withColumns({f"_w_{c}": F.col(f"_w_{c}") - F.col(f"_u_{c}") for c in names})
    df = df.withColumns({f"_e_{c}": _earlier(f"_w_{c}", n) for c in names} | {f"_k1_{k}": _earlier(f"_k0_{k}", n) for k in steps})
    made = {}
    for p in parts:
        for c in p.terms:
            now, before = F.col(f"_u_{c}"), F.col(f"_e_{c}")
            if p.k is not None:
                now, before = now * weight(p, "_k0", -1), before * weight(p, "_k1", -1)
            made[c] = now + F.coalesce(before, F.lit(0.0))
    return df.withColumns(made).drop(_BLOCK, *[f"{t}_{k}" for t in ("_k0", "_k1") for k in steps], *[f"_{t}_{c}" for t in "tuwe" for c in names])


def moving_sums(df: DataFrame, n: int, **terms: Column) -> DataFrame:
    """Adds the sum of each term over the last n rows of the symbol; unknown terms count as zero."""
    return frame_sums(df, n, Sums(terms))


def decayed_sums(df: DataFrame, n: int, k: Column, half_life: float, **terms: Column) -> DataFrame:
    """Adds the sum of each term over the last n rows, a term of k steps ago weighted by 2^(-k / half_life)."""
    return frame_sums(df.withColumn("_k", k), n, Sums(terms, "_k", half_life)).drop("_k")


def moving_totals(df: DataFrame, n: int, **terms: Column) -> DataFrame:
    """As moving_sums, by adding only: a running sum and one that runs backwards, so a frame of zeros has the sum 0.

    One more sort than moving_sums, for sums that are compared with 0 or divided by each other.
    """
    names = list(terms)
    df = _blocked(df, n).withColumns({f"_t_{c}": F.coalesce(x.cast("double"), F.lit(0.0)) for c, x in terms.items()})
    df = df.withColumns({f"_b_{c}": F.sum(f"_t_{c}").over(_upto(True)) for c in names})
    df = df.withColumns({f"_u_{c}": F.sum(f"_t_{c}").over(_upto()) for c in names} | {f"_p_{c}": _earlier(f"_b_{c}", n - 1) for c in names})
    # On the last row of a block the whole frame is the block: what is left of the one before is not in it.
    df = df.withColumns({c: F.col(f"_u_{c}") + F.coalesce(F.when(F.col("i") % n != n - 1, F.col(f"_p_{c}")), F.lit(0.0)) for c in names})
    return df.drop(_BLOCK, *[f"_{k}_{c}" for k in "tbup" for c in names])


def moving_extremes(df: DataFrame, n: int, x: Column, low: str, high: str) -> DataFrame:
    """Adds the least and the greatest known x of the last n rows, frames of fewer rows included."""
    df = _blocked(df, n).withColumn("_x", x)
    df = df.withColumns({"_b_lo": F.min("_x").over(_upto(True)), "_b_hi": F.max("_x").over(_upto(True))})
    df = df.withColumns({"_u_lo": F.min("_x").over(_upto()), "_u_hi": F.max("_x").over(_upto())})
    # greatest and least pass over unknown values.
    df = df.withColumns({"_p_lo": _earlier("_b_lo", n - 1), "_p_hi": _earlier("_b_hi", n - 1)})
    df = df.withColumns({low: F.least("_u_lo", "_p_lo"), high: F.greatest("_u_hi", "_p_hi")})
    return df.drop(_BLOCK, "_x", *[f"_{k}_{c}" for k in "bup" for c in ("lo", "hi")])


def moving_regression(df: DataFrame, n: int, y: Column, x: Column, slope: str, intercept: str) -> DataFrame:
    """Adds slope and intercept of y on x over the last n rows, from the n-th row on; unknown values are zero.

    Values are taken relative to the symbol's means, which keeps the sums of squares small.
    """
    own = W.partitionBy("symbol")
    df = df.withColumns({"_y": F.coalesce(y, F.lit(0.0)), "_x": F.coalesce(x, F.lit(0.0))})
    df = df.withColumns({"_my": F.avg("_y").over(own), "_mx": F.avg("_x").over(own)})
    order = W.partitionBy("symbol").orderBy("tradedate")
    df = df.withColumn("_moved", F.coalesce((F.col("_x") != F.lag("_x", 1).over(order)).cast("double"), F.lit(0.0)))
    p, q = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    df = moving_sums(df, n, _sx=p, _sy=q, _sxx=p * p, _sxy=p * q, _moves=F.col("_moved"))
    sx, sy, sxx, sxy = (F.col(c) for c in ("_sx", "_sy", "_sxx", "_sxy"))
    # A frame of equal x, without a move but perhaps to its first row, has no slope.
    varies = F.col("_moves") - F.coalesce(F.lag("_moved", n - 1).over(order), F.lit(0.0)) > 0
    df = df.withColumn(slope, F.when((F.col("i") >= n - 1) & varies, F.try_divide(sxy - sx * sy / n, sxx - sx * sx / n)))
    level = (sy - F.col(slope) * sx) / n + F.col("_my") - F.col(slope) * F.col("_mx")
    return df.withColumn(intercept, level).drop("_y", "_x", "_my", "_mx", "_moved", "_moves", "_sx", "_sy", "_sxx", "_sxy")


def decay_sums(x: Column, k: str, half_life: float, how: str = "sum") -> list[Sums]:
    """The sums that `decayed` reads; k counts the known x so far."""
    parts = [Sums({"_n": x.isNotNull().cast("double")}), Sums({"_s": x}, k, half_life)]
    # The square of a weighted value halves twice as fast.
    return parts if how == "sum" else [*parts, Sums({"_ss": x * x}, k, half_life / 2)]


def decayed(least: int, how: str = "sum") -> Column:
    """Sum or population deviation from the sums of `decay_sums`."""
    if how == "sum":
        return F.when(F.col("_n") >= least, F.col("_s"))
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    spread = F.try_divide(F.col("_ss"), F.col("_n")) - mean * mean
    return F.when(F.col("_n") >= least, F.sqrt(F.greatest(spread, F.lit(0.0))))


def decay(df: DataFrame, name: str, x: Column, n: int, half_life: float, how: str = "sum", least: int | None = None) -> DataFrame:
    """Adds the sum or the population deviation of the frame's known values, each halved every half_life known values.

    The newest known value has the weight 1; `least` known values are needed.
    """
    df = df.withColumn("_v", x).withColumn("_n_so_far", F.count("_v").over(so_far()))
    df = frame_sums(df, n, *decay_sums(F.col("_v"), "_n_so_far", half_life, how))
    return df.withColumn(name, decayed(least or n, how)).drop("_v", "_n_so_far", "_n", "_s", "_ss")


def linear_residuals(df: DataFrame, y: Column, x: Column, n: int = 8) -> DataFrame:
    """Adds the readings of a regression of y on x over a symbol's last n rows, both filled forward before.

    reg: the last residual; z_reg: the same with y and x as z-scores of the frame; reg_resi: population deviation of
    the frame's residuals; slope; qoq: change of y over the row before less that of x. A frame with an unknown value,
    or with equal x, has none; a zero base has no change. df needs tradedate and symbol.
    """
    own = W.partitionBy("symbol").orderBy("tradedate")
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_ry": F.last(y, ignorenulls=True).over(so_far), "_rx": F.last(x, ignorenulls=True).over(so_far), "i": F.row_number().over(own) - 1})
    q, p = F.col("_ry"), F.col("_rx")
    df = moving_regression(df, n, q, p, "_b", "_a")
    # Squares relative to the symbol's mean; the frame's deviation of y.
    df = df.withColumns({"_my": F.avg("_ry").over(W.partitionBy("symbol")), "_mx": F.avg("_rx").over(W.partitionBy("symbol"))})
    v, u = q - F.col("_my"), p - F.col("_mx")
    df = moving_sums(df, n, _n=(q + p).isNotNull().cast("double"), _s=v, _ss=v * v, _t=u, _tt=u * u)
    var_y, var_x = F.col("_ss") / n - (F.col("_s") / n) ** 2, F.col("_tt") / n - (F.col("_t") / n) ** 2
    known, b = F.col("_n") >= n, F.col("_b")
    residual = q - b * p - F.col("_a")
    df = df.withColumns({
        "reg": F.when(known, residual), "z_reg": F.when(known & (var_y > 0), F.try_divide(residual, F.sqrt(var_y))),
        "reg_resi": F.when(known, F.sqrt(F.greatest(var_y - b * b * var_x, F.lit(0.0)))), "slope": F.when(known, b),
    })
    qoq = F.try_divide(q, F.lag(q, 1).over(own)) - F.try_divide(p, F.lag(p, 1).over(own))
    df = df.withColumn("reg_resi", F.when(b.isNotNull(), F.col("reg_resi"))).withColumn("qoq", qoq)
    return df.drop("_ry", "_rx", "i", "_b", "_a", "_my", "_mx", "_n", "_s", "_ss", "_t", "_tt")


def moving_moments(df: DataFrame, n: int, **terms: Column) -> DataFrame:
    """Adds n, mean and sample deviation (<name>_n, <name>_mean, <name>_std) of each term's known values in the last n rows.

    Moments of the current block so far and of what is left of the block before are each running ones (forwards
    and backwards), and are merged by their means, so no large squares are taken from each other.
    """
    names = list(terms)
    df = _blocked(df, n).withColumns({f"_t_{c}": x.cast("double") for c, x in terms.items()})

    def moments(c: str, w: WindowSpec) -> Column:
        return F.struct(F.count(f"_t_{c}").over(w).alias("n"), F.avg(f"_t_{c}").over(w).alias("mean"), F.var_pop(f"_t_{c}").over(w).alias("var"))

    df = df.withColumns({f"_b_{c}": moments(c, _upto(True)) for c in names})
    df = df.withColumns({f"_u_{c}": moments(c, _upto()) for c in names})
    df = df.withColumns({f"_p_{c}": _earlier(f"_b_{c}", n - 1) for c in names})
    for c in names:
        # On the last row of a block the whole frame is the block: what is left of the one before is not in it.
        p = F.when(F.col("i") % n != n - 1, F.col(f"_p_{c}"))
        n1, n2 = F.col(f"_u_{c}.n"), F.coalesce(p["n"], F.lit(0))
        m1, m2 = F.coalesce(F.col(f"_u_{c}.mean"), F.lit(0.0)), F.coalesce(p["mean"], F.lit(0.0))
        total = n1 + n2
        mean = F.try_divide(n1 * m1 + n2 * m2, total.cast("double"))
        squares = n1 * F.coalesce(F.col(f"_u_{c}.var"), F.lit(0.0)) + n2 * F.coalesce(p["var"], F.lit(0.0)) + F.try_divide((m1 - m2) * (m1 - m2) * n1 * n2, total.cast("double"))
        df = df.withColumns({f"{c}_n": total, f"{c}_mean": mean, f"{c}_std": F.sqrt(F.try_divide(squares, F.when(total > 1, (total - 1).cast("double"))))})
    return df.drop(_BLOCK, *[f"_{k}_{c}" for k in "tbup" for c in names])


def moving_correlation(df: DataFrame, n: int, x: Column, y: Column, name: str) -> DataFrame:
    """Adds the Pearson correlation of x and y over the last n rows; a frame with an unknown pair, or of equal x or y, has none.

    As moving_moments: two running parts, merged by their means.
    """
    known = x.isNotNull() & y.isNotNull()
    df = _blocked(df, n).withColumns({"_x": F.when(known, x.cast("double")), "_y": F.when(known, y.cast("double"))})

    def moments(w: WindowSpec) -> Column:
        means = [F.avg(c).over(w).alias(f"m{c}") for c in ("_x", "_y")]
        return F.struct(F.count("_x").over(w).alias("n"), *means, F.var_pop("_x").over(w).alias("xx"), F.var_pop("_y").over(w).alias("yy"), F.covar_pop("_x", "_y").over(w).alias("xy"))

    df = df.withColumn("_b", F.struct("_x", "_y", moments(_upto(True)).alias("m"))).withColumn("_u", moments(_upto())).withColumn("_p", _earlier("_b", n - 1))
    u, p = F.col("_u"), F.col("_p.m")
    # The frame is the block on its last row, else it has n rows only where there is a block before.
    whole = F.col("i") % n == n - 1
    enough = F.when(whole, u["n"]).otherwise(u["n"] + p["n"]) >= n

    def spread(a: str, b: str) -> Column:
        apart = (u[f"m_{a}"] - p[f"m_{a}"]) * (u[f"m_{b}"] - p[f"m_{b}"]) * u["n"] * p["n"] / n
        return F.when(whole, u[a + b] * n).otherwise(u[a + b] * u["n"] + p[a + b] * p["n"] + apart)

    def varies(c: str) -> Column:
        # Parts of equal values have no spread, but means that rounding moves.
        flat = (u[c * 2] == 0) & (whole | ((p[c * 2] == 0) & (F.col(f"_p._{c}") == F.col(f"_{c}"))))
        return ~flat

    r = F.try_divide(spread("x", "y"), F.sqrt(spread("x", "x")) * F.sqrt(spread("y", "y")))
    df = df.withColumn(name, F.when(enough & varies("x") & varies("y"), r))
    return df.drop(_BLOCK, "_x", "_y", "_b", "_u", "_p")


#: A regressor that keeps less of its variance than this beside those before it counts as dependent on them.
DEPENDENT = 1e-9


def rolling_ols_std(df: DataFrame, y: str, x: str, n: int = 8, name: str = "back_forth_std") -> DataFrame:
    """Population deviation of the residuals of y on x, x one row back and x one row ahead, over n rows.

    Normal equations of the frame's centred moments are solved by elimination; a regressor that depends on those
    before it is left out, so singular frames have the residuals of their span. A frame with an unknown value has none.
    """
    w, before = by_symbol().rowsBetween(1 - n, 0), df.columns
    df = df.withColumns({"_x0": F.col(x).cast("double"), "_x1": F.lag(x, 1).over(by_symbol()).cast("double"), "_x2": F.lead(x, 1).over(by_symbol()).cast("double"), "_x3": F.col(y).cast("double")})
    known = F.col("_x0").isNotNull() & F.col("_x1").isNotNull() & F.col("_x2").isNotNull() & F.col("_x3").isNotNull()
    df = df.withColumn("_all", known).withColumn("_frame", F.collect_list(F.when(F.col("_all"), F.array("_x0", "_x1", "_x2", "_x3"))).over(w))
    df = df.withColumns({f"_s{j}{k}": F.covar_pop(f"_x{j}", f"_x{k}").over(w) for j in range(4) for k in range(j, 4)} | {f"_m{j}": F.avg(f"_x{j}").over(w) for j in range(4)})
    for j in range(3):
        # What is left of the others' moments once regressor j is taken out.
        df = df.withColumn(f"_ok{j}", F.col(f"_s{j}{j}") > (DEPENDENT * F.col(f"_v{j}") if j else F.lit(0.0)))
        part = {k: F.when(F.col(f"_ok{j}"), F.col(f"_s{j}{k}") / F.col(f"_s{j}{j}")).otherwise(0.0) for k in range(j + 1, 4)}
        if not j:
            df = df.withColumns({f"_v{k}": F.col(f"_s{k}{k}") for k in (1, 2)})
        df = df.withColumns({f"_r{j}{k}": p for k, p in part.items()})
        df = df.withColumns({f"_s{k}{m}": F.col(f"_s{k}{m}") - F.col(f"_r{j}{k}") * F.col(f"_s{j}{m}") for k in range(j + 1, 4) for m in range(k, 4)})
    b2 = F.col("_r23")
    b1 = F.col("_r13") - F.col("_r12") * b2
    df = df.withColumns({"_b1": b1, "_b2": b2}).withColumn("_b0", F.col("_r03") - F.col("_r01") * F.col("_b1") - F.col("_r02") * F.col("_b2"))

    def residual(row: Column) -> Column:
        fitted = sum((F.col(f"_b{j}") * (row[j] - F.col(f"_m{j}")) for j in range(3)), F.lit(0.0))
        return row[3] - F.col("_m3") - fitted

    squares = F.aggregate("_frame", F.lit(0.0), lambda total, row: total + residual(row) * residual(row))
    return df.select(*before, F.when(F.size("_frame") >= n, F.sqrt(squares / n)).alias(name))
