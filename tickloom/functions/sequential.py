"""Indicators whose value depends on the one before: NumPy recurrences over one symbol's bars, all in one grouped pass.

Values are NaN before the lookback is full. `pack` sorts each symbol's bars itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: np.ndarray, n: int, start: int | None = None) -> np.ndarray:
    """Exponential mean with alpha 2 / (n + 1), seeded with the plain mean of n values that end at `start` (n - 1)."""
    out = np.full(len(x), np.nan)
    start = n - 1 if start is None else start
    if len(x) > start:
        value, alpha = x[start - n + 1 : start + 1].mean(), 2 / (n + 1)
        out[start] = value
        for i in range(start + 1, len(x)):
            value += alpha * (x[i] - value)
            out[i] = value
    return out


def ema_from_first(x: np.ndarray, alpha: float) -> np.ndarray:
    out = np.empty(len(x))
    for i, v in enumerate(x):
        out[i] = v if i == 0 else alpha * v + (1 - alpha) * out[i - 1]
    return out


def ewm(x: np.ndarray, span: int) -> np.ndarray:
    """Weights (1 - alpha)^k of all values so far, as a weighted mean."""
    keep, top, bottom, out = 1 - 2 / (span + 1), 0.0, 0.0, np.empty(len(x))
    for i, v in enumerate(x):
        top, bottom = top * keep + v, bottom * keep + 1
        out[i] = top / bottom
    return out


def wilder(x: np.ndarray, n: int, first: int) -> np.ndarray:
    """Wilder's mean, seeded with the plain mean of x[first : first + n]."""
    out = np.full(len(x), np.nan)
    if len(x) >= first + n:
        value = x[first : first + n].mean()
        out[first + n - 1] = value
        for i in range(first + n, len(x)):
            value = (value * (n - 1) + x[i]) / n
            out[i] = value
    return out


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram; both means start at bar slow - 1, all three come out once the signal is there."""
    line = ema(close, fast, slow - 1) - ema(close, slow)
    mark = np.full(len(close), np.nan)
    mark[slow - 1 :] = ema(line[slow - 1 :], signal)
    line = np.where(np.isnan(mark), np.nan, line)
    return line, mark, line - mark


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    d = np.diff(close, prepend=close[:1])
    gain, loss = wilder(np.maximum(d, 0), n, 1), wilder(np.maximum(-d, 0), n, 1)
    both = gain + loss
    return np.where(both > 0, 100 * gain / np.where(both > 0, both, 1), np.where(np.isnan(both), np.nan, 0.0))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([close[:1], close[:-1]])
    out = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out[:1] = (high - low)[:1]
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(true_range(high, low, close), n, 1)


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX: sums start with n - 1 bars and decay by 1/n, the ADX starts with the mean of n values."""
    size = len(close)
    plus, minus, adx = (np.full(size, np.nan) for _ in range(3))
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    rise, fall = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    spread = true_range(high, low, close)
    if size <= n:
        return plus, minus, adx
    sums = [x[1:n].sum() for x in (rise, fall, spread)]
    held, value = [], np.nan
    for i in range(n, size):
        sums = [s - s / n + x[i] for s, x in zip(sums, (rise, fall, spread), strict=True)]
        if sums[2] > 0:
            plus[i], minus[i] = 100 * sums[0] / sums[2], 100 * sums[1] / sums[2]
        else:
            plus[i] = minus[i] = 0.0
        both = plus[i] + minus[i]
        if both > 0 or len(held) < n:
            dx = 100 * abs(plus[i] - minus[i]) / both if both > 0 else 0.0
            if len(held) < n:
                held.append(dx)
                value = sum(held) / n if len(held) == n else np.nan
            else:
                value = (value * (n - 1) + dx) / n
        adx[i] = value
    return plus, minus, adx


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Stop and reverse. The first direction is down if the low fell by more than the high rose."""
    out = np.full(len(high), np.nan)
    if len(high) < 2:
        return out
    sign = -1 if low[0] - low[1] > max(high[1] - high[0], 0) else 1
    # The downward case is the upward one of mirrored prices.
    ahead = (lambda i: high[i] if sign > 0 else -low[i]), (lambda i: low[i] if sign > 0 else -high[i])
    extreme, stop, pace = ahead[0](1), ahead[1](0), step
    for i in range(1, len(high)):
        before = max(i - 1, 1)
        if ahead[1](i) <= stop:
            sign, stop = -sign, -max(extreme, ahead[0](before), ahead[0](i))
            out[i] = sign * stop
            extreme, pace = ahead[0](i), step
        else:
            out[i] = sign * stop
            if ahead[0](i) > extreme:
                extreme, pace = ahead[0](i), min(pace + step, most)
        stop = min(stop + pace * (extreme - stop), ahead[1](before), ahead[1](i))
    return out


def chaikin(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, fast: int = 3, slow: int = 10) -> np.ndarray:
    gap = high - low
    flow = np.where(gap > 0, ((close - low) - (high - close)) / np.where(gap > 0, gap, 1) * volume, 0.0).cumsum()
    out = ema_from_first(flow, 2 / (fast + 1)) - ema_from_first(flow, 2 / (slow + 1))
    out[: slow - 1] = np.nan
    return out


def ewma_volatility(close: np.ndarray, decay: float = 0.94, least: int = 10) -> np.ndarray:
    """Root of 252 times the decayed mean of squared returns, seeded with the first."""
    out, value = np.full(len(close), np.nan), np.nan
    for i in range(1, len(close)):
        square = (close[i] / close[i - 1] - 1) ** 2 if close[i - 1] else 0.0
        value = square if i == 1 else decay * value + (1 - decay) * square
        if i >= least:
            out[i] = np.sqrt(value * 252)
    return out


VALUES = ("ema_12", "ema_26", "ema_50", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "plus_di", "minus_di", "adx", "sar", "keltner_mid", "keltner_upper", "keltner_lower", "chaikin_osc", "ewma_vol", "ema_smooth", "macd_ewm")


def compute(bars: pd.DataFrame) -> pd.DataFrame:
    """One symbol's bars with all of VALUES."""
    bars = bars.sort_values("ts", kind="stable")
    high, low, close, volume = (bars[c].to_numpy(dtype=float) for c in ("high", "low", "close", "volume"))
    mid, range20 = ema(close, 20), atr(high, low, close, 20)
    plus, minus, adx = directional(high, low, close)
    line, mark, hist = macd(close)
    columns = (ema(close, 12), ema(close, 26), ema(close, 50), line, mark, hist, rsi(close), atr(high, low, close), plus, minus, adx, parabolic_sar(high, low), mid, mid + 2 * range20, mid - 2 * range20, chaikin(high, low, close, volume), ewma_volatility(close), ema_from_first(close, 0.1), ewm(close, 12) - ewm(close, 26))
    return bars.assign(**dict(zip(VALUES, columns, strict=True)))


def pack(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """bars with all of VALUES, null where they are not defined: one shuffle by symbol for all of them. A symbol's bars go to one task."""
    schema = T.StructType([*bars.schema.fields, *[T.StructField(v, T.DoubleType()) for v in VALUES]])
    return bars.groupBy(by).applyInPandas(lambda g: compute(g)[schema.names].replace({np.nan: None}), schema)
