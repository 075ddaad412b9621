"""Ranks in long frames, where a row's result needs all of its frame's values: one symbol's rows in one place.

Each group is one symbol, whose rows are bounded by the calendar; Arrow carries keys and inputs to numpy and back. What
window expressions can do is in `scan` (recurrences) and `moving` (sums, moments, regressions).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .moving import rolling_ols_std
from .scan import ewm_mean, intangible_assets, rsi

__all__ = ["ewm_mean", "intangible_assets", "rolling_ols_std", "rolling_rank_pct", "rolling_spearman", "rsi", "ts_corr"]


def per_symbol(df: DataFrame, inputs: list[str], added: list[str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """tradedate, symbol, inputs and double columns that fn makes of one symbol's rows in date order."""
    df = df.select("tradedate", "symbol", *dict.fromkeys(inputs))
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in added]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tradedate", kind="stable")
        return pdf.assign(**{c: np.where(np.isfinite(v), v, np.nan) for c, v in fn(pdf).items()})

    return df.groupBy("symbol").applyInPandas(run, schema)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """Frame of n rows ending at each row, padded with NaN."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def _ordinal(a: np.ndarray) -> np.ndarray:
    order = np.argsort(a, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(a.shape[1])[None, :], axis=1)
    return ranks


def ts_corr(df: DataFrame, x: str, y: str, n: int = 20, name: str = "ts_corr") -> DataFrame:
    """Rolling Spearman by ordinal ranks (unknown values last); the first n - 1 rows are 0."""

    def fn(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = (_ordinal(_windows(pdf[c].to_numpy(float), n)) for c in (x, y))
        out = 1 - 6 * ((a - b) ** 2).sum(axis=1) / (n * (n * n - 1.0))
        out[: n - 1] = 0.0
        return {name: out}

    return per_symbol(df, [x, y], [name], fn)


def count_below(codes: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of codes[low:high] are less than `least`, for every query at once.

    Codes are whole numbers from 0. They are dealt by one bit after the other, the highest first; where a query's bit
    is set, all with a 0 there are less and those with a 1 go on, else those with a 0 go on. So a query takes a step
    a bit, whatever the length of its range.
    """
    low, high, out = low.copy(), high.copy(), np.zeros(len(least), np.int64)
    bits = max(1, int(least.max(initial=0)).bit_length(), int(codes.max(initial=0)).bit_length())
    for bit in range(bits - 1, -1, -1):
        one = (codes >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        z_low, z_high, up = zeros[low], zeros[high], ((least >> bit) & 1).astype(bool)
        out += np.where(up, z_high - z_low, 0)
        low, high = np.where(up, zeros[-1] + low - z_low, z_low), np.where(up, zeros[-1] + high - z_high, z_high)
        codes = np.concatenate([codes[one == 0], codes[one == 1]])
    return out


def rank_pct(v: np.ndarray, n: int, least: int) -> np.ndarray:
    """Average rank of each value among the known ones of its frame over their number; NaN is unknown."""
    known = ~np.isnan(v)
    upto = np.concatenate([[0], np.cumsum(known)])
    at = np.flatnonzero(known)
    out = np.full(len(v), np.nan)
    if not len(at):
        return out
    codes = np.unique(v[at], return_inverse=True)[1].astype(np.int64)
    low, high = upto[np.maximum(at + 1 - n, 0)], upto[at + 1]
    less, upto_same = (count_below(codes, low, high, codes + k) for k in (0, 1))
    size = high - low
    out[at] = np.where(size >= least, (less + (upto_same - less + 1) / 2) / size, np.nan)
    return out


def rolling_rank_pct(df: DataFrame, x: str, n: int, name: str, least: int | None = None) -> DataFrame:
    """Average rank of the current value in its frame over the number known there; a row's time doesn't grow with n.

    Returns tradedate, symbol, x and the rank.
    """
    return per_symbol(df, [x], [name], lambda pdf: {name: rank_pct(pdf[x].to_numpy(float), n, least or n)})


#: Signs of differences that are held at a time.
_SIGNS = 1 << 20


def spearman(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Spearman correlation of every frame of n rows, average ranks; NaN where a frame is not known in full.

    A rank is, but for a constant, half the sum of the signs of the differences to all of the frame. As the frame
    moves a row, every sum loses the sign to the value that leaves and gains the one to the value that enters, so a row
    costs n steps. Sums of signs are whole, so nothing is lost to rounding.
    """
    size = len(x)
    known = ~(np.isnan(x) | np.isnan(y))
    full = np.convolve(known, np.ones(n, int))[:size] == n if size >= n else np.zeros(size, bool)
    pad = [np.concatenate([np.zeros(n), np.nan_to_num(v), np.zeros(n)]) for v in (x, y)]
    moments = np.zeros((3, size + n))
    step = max(1, _SIGNS // (2 * n))
    for at in range(0, size, step):
        m = min(step, size - at)
        sums = []
        for v in pad:
            # Row i against the rows from n - 1 before it to n - 1 after it.
            around = np.lib.stride_tricks.sliding_window_view(v[at + 1 : at + m + 2 * n - 1], 2 * n - 1)
            upto = np.cumsum(np.sign(v[at + n : at + n + m, None] - around), axis=1)
            # The frame that ends k rows after i: from n - 1 - k before it.
            sums.append(upto[:, n - 1 :] - np.concatenate([np.zeros((m, 1)), upto[:, : n - 1]], axis=1))
        ends = (np.arange(at, at + m)[:, None] + np.arange(n)).ravel()
        for j, (p, q) in enumerate(((0, 0), (1, 1), (0, 1))):
            moments[j] += np.bincount(ends, (sums[p] * sums[q]).ravel(), size + n)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = moments[2] / np.sqrt(moments[0] * moments[1])
    return np.where(full, r[:size], np.nan)


def rolling_spearman(df: DataFrame, x: str, y: str, n: int, name: str) -> DataFrame:
    """Rolling Spearman with average ranks; a frame must be known in full. Returns tradedate, symbol, x, y and it."""
    return per_symbol(df, [x, y], [name], lambda pdf: {name: spearman(pdf[x].to_numpy(float), pdf[y].to_numpy(float), n)})
