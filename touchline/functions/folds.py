"""Ordered folds: recursive smoothing over one instrument's candles in time order.

These recurrences need the value before, so that one instrument is one task; its candles number millions at most (a century
of minutes is 50 million rows of a few numbers). All instruments fold in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fold(candles: DataFrame, columns: dict[str, str], compute: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """``candles`` with columns (name to type) computed over each instrument's rows in order of ``bar_idx``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in candles.schema if f.name not in columns), *(f"`{n}` {t}" for n, t in columns.items())])
    names = [c for c in candles.columns if c not in columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bar_idx", ignore_index=True)
        made = compute(frame)
        return frame[names].assign(**{n: pd.Series(made[n]).replace({np.nan: None}) if t == "string" else made[n] for n, t in columns.items()})

    return candles.groupBy("instrument").applyInPandas(run, schema)


def exponential(values: np.ndarray, alpha: float, least: int = 1, seed: float | None = None) -> np.ndarray:
    """s = alpha x + (1 - alpha) s, from the first value; null until ``least`` values were seen."""
    out, keep = np.empty(len(values)), 1.0 - alpha
    state = None
    for i, x in enumerate(values.tolist()):
        state = (x if seed is None else seed) if state is None else alpha * x + keep * state
        out[i] = state
    out[: least - 1] = np.nan
    return out


def wilder(values: np.ndarray, period: int, first: int) -> np.ndarray:
    """Wilder's mean: the plain mean of ``period`` values from ``first`` on, then (s (p - 1) + x) / p; null before."""
    out = np.full(len(values), np.nan)
    start = first + period - 1
    if len(values) > start:
        state = out[start] = float(values[first : start + 1].mean())
        for i in range(start + 1, len(values)):
            state = out[i] = (state * (period - 1) + values[i]) / period
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate((close[:1], close[:-1]))
    out = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    if len(out):
        out[0] = high[0] - low[0]
    return out


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int) -> np.ndarray:
    """Wilder's average directional index (1978)."""
    n = len(close)
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    ranges = wilder(true_range(high, low, close), period, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = 100 * wilder(plus, period, 1) / ranges, 100 * wilder(minus, period, 1) / ranges
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), 0.0)
    return wilder(dx, period, period) if n > 2 * period else np.full(n, np.nan)


def turn(peak: np.ndarray, back: np.ndarray, threshold: np.ndarray, start: int) -> int | None:
    """The first bar after ``start`` without a new extreme whose other side lies below the extreme so far by more than the threshold.

    Searched in stretches that double, so that a leg costs its own length.
    """
    at, best, width = start + 1, peak[start], 64
    while at < len(peak):
        stop = min(at + width, len(peak))
        so_far = np.maximum.accumulate(np.append(best, peak[at:stop]))
        turned = (peak[at:stop] <= so_far[:-1]) & (back[at:stop] < so_far[:-1] - threshold[at:stop])
        if turned.any():
            return at + int(turned.argmax())
        at, best, width = stop, so_far[-1], 2 * width
    return None


def swings(high: np.ndarray, low: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running support and resistance: the last confirmed swing low and high.

    Legs rise and fall in turn, the first one rises. A leg's extreme is confirmed by the bar that turns back from it by more than
    that bar's threshold, and the next leg starts at that bar: a falling leg is a rising one of the mirrored prices. Prices are in
    single precision; the first row has no value, and what is confirmed before any swing is the first bar's own low and high.
    """
    high, low = high.astype(np.float32), low.astype(np.float32)
    levels = [np.full(len(high), x[0] if len(x) else np.nan, np.float32) for x in (low, high)]
    sides, start, leg = ((high, low, 1), (-low, -high, 0)), 0, 0
    while len(high) and (bar := turn(*sides[leg][:2], threshold, start)) is not None:
        peak, _, level = sides[leg]
        extreme = peak[start:bar].max()
        levels[level][bar:] = extreme if level else -extreme
        start, leg = bar, 1 - leg
    for x in levels:
        x[:1] = np.nan
    return levels[0], levels[1]
