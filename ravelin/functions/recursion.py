"""Recursive indicators: one ordered pass over each instrument's bars. Executors import this module."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema_of(x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Seeded by the mean of the first n values from `start`; then alpha = 2 / (n + 1)."""
    out = np.full(len(x), np.nan)
    if len(x) - start >= n:
        at, alpha = start + n - 1, 2 / (n + 1)
        value = out[at] = x[start : start + n].mean()
        for i in range(at + 1, len(x)):
            value += alpha * (x[i] - value)
            out[i] = value
    return out


def wilder_of(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded by the mean of x[1 : n + 1]; then alpha = 1 / n."""
    out = np.full(len(x), np.nan)
    if len(x) > n:
        value = out[n] = x[1 : n + 1].mean()
        for i in range(n + 1, len(x)):
            value = out[i] = (value * (n - 1) + x[i]) / n
    return out


def rsi_of(close: np.ndarray, n: int) -> np.ndarray:
    move = np.diff(close, prepend=np.nan)
    up, down = wilder_of(np.maximum(move, 0), n), wilder_of(np.maximum(-move, 0), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down == 0, 0.0, 100 * up / (up + down)) + 0 * up


def range_of(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(high, before) - np.fmin(low, before)


def atr_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return wilder_of(range_of(high, low, close), n)


def adx_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Directional index, its running sums begun over n - 1 bars and its mean over n of the indices after."""
    out = np.full(len(close), np.nan)
    if len(close) < 2 * n:
        return out
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = range_of(high, low, close)
    p, m, t = (x[1:n].sum() for x in (plus, minus, tr))
    total = value = 0.0
    for i in range(n, len(close)):
        p, m, t = p - p / n + plus[i], m - m / n + minus[i], t - t / n + tr[i]
        dx = 100 * abs(p - m) / (p + m) if p + m > 0 else 0.0
        if i < 2 * n - 1:
            total += dx
        elif i == 2 * n - 1:
            value = out[i] = (total + dx) / n
        else:
            value = out[i] = (value * (n - 1) + dx) / n
    return out


def macd_of(close: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema_of(close, fast, slow - fast) - ema_of(close, slow)
    sig = ema_of(line, signal, slow - 1)
    return np.where(np.isnan(sig), np.nan, line), sig, line - sig


Pass = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def per_instrument(bars: DataFrame, fn: Pass, columns: dict[str, str], key: str = "instrument") -> DataFrame:
    """bars with columns from one ordered pass over each instrument's bars. NaN becomes null."""
    names = bars.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields), *(f"`{c}` {t}" for c, t in columns.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        made = fn(pdf)
        out = pdf[names].copy()
        for c in columns:
            v = np.asarray(made[c])
            out[c] = pd.Series(v).where(~pd.isna(v), None) if v.dtype.kind == "f" else v
        return out

    return bars.groupBy(key).applyInPandas(run, schema)


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(pdf[c].to_numpy(float) for c in ("open", "high", "low", "close"))


def recursive(bars: DataFrame, **wanted: tuple) -> DataFrame:
    """Columns by name: ("ema", n), ("rsi", n), ("atr", n), ("adx", n) or ("macd", fast, slow, signal) (three columns)."""

    def fn(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        _, h, lo, c = arrays(pdf)
        out: dict[str, np.ndarray] = {}
        for name, (kind, *p) in wanted.items():
            if kind == "macd":
                out |= dict(zip((name, f"{name}_signal", f"{name}_hist"), macd_of(c, *p), strict=True))
            else:
                out[name] = {"ema": lambda: ema_of(c, *p), "rsi": lambda: rsi_of(c, *p), "atr": lambda: atr_of(h, lo, c, *p), "adx": lambda: adx_of(h, lo, c, *p)}[kind]()
        return out

    columns: dict[str, str] = {}
    for name, (kind, *_) in wanted.items():
        columns |= dict.fromkeys([name, f"{name}_signal", f"{name}_hist"] if kind == "macd" else [name], "double")
    return per_instrument(bars, fn, columns)
