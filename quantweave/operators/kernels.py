"""Numeric kernels of the recursive indicators: plain NumPy on one instrument's arrays.

Seeds follow the published definitions: EMA and Wilder averages start from the
plain mean of the first n values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from quantweave.functions.periods import PERIODS


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Seed with the mean of the first n present values, then step by alpha."""
    out = np.full(len(x), np.nan)
    present = np.flatnonzero(~np.isnan(x))
    if len(present) < n:
        return out
    first = present[0] + n - 1
    tail = np.array(x[first:], dtype=float)
    tail[0] = np.mean(x[present[0]:first + 1])
    out[first:] = ewm(tail, alpha)
    return out


def ema(x, n):
    return smooth(x, n, 2.0 / (n + 1))


def wilder(x, n):
    return smooth(x, n, 1.0 / n)


def change(x):
    return np.concatenate([[np.nan], np.diff(x)])


def ratio(a, b, empty=np.nan):
    with np.errstate(divide="ignore", invalid="ignore"):
        r = a / b
    return np.where(np.isnan(a) | np.isnan(b), np.nan, np.where(b == 0, empty, r))


def split_moves(x, n):
    d = change(x)
    return wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(
        np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)


def rsi(x, n):
    u, w = split_moves(x, n)
    return 100 * ratio(u, u + w, 0.0)


def cmo(x, n):
    u, w = split_moves(x, n)
    return 100 * ratio(u - w, u + w, 0.0)


def macd(x, fast, slow, signal):
    """Both averages start on the slow average's first row; the fast one is
    seeded with the mean of the last ``fast`` values up to that row."""
    head = x.copy()
    head[:max(slow - fast, 0)] = np.nan
    line = ema(head, fast) - ema(x, slow)
    sig = ema(line, signal)
    line = np.where(np.isnan(sig), np.nan, line)
    return line, sig, line - sig


def true_range(h, lo, c):
    pc = np.concatenate([[np.nan], c[:-1]])
    return np.fmax(h - lo, np.fmax(np.abs(h - pc), np.abs(lo - pc))) + 0 * pc


def directional(h, lo, c, n):
    """+DI, -DI: sums of the first n-1 moves, then Wilder-decayed sums."""
    up, down = change(h), -change(lo)
    plus = np.where((up > 0) & (up > down), up, 0.0)
    minus = np.where((down > 0) & (down > up), down, 0.0)
    tr = true_range(h, lo, c)

    def decayed(x):
        out = np.full(len(x), np.nan)
        if len(x) > n:
            # the decayed sum is n times an exponential average that starts from the sum of the first values
            start = float(np.sum(x[1:n]))
            out[n:] = n * ewm(np.r_[start / n, x[n:]], 1 / n)[1:]
        return out
    base = decayed(tr)
    return 100 * ratio(decayed(plus), base, 0.0), 100 * ratio(decayed(minus), base, 0.0)


def adx(h, lo, c, n):
    p, m = directional(h, lo, c, n)
    dx = 100 * ratio(np.abs(p - m), p + m)
    known = pd.Series(np.where(p + m == 0, np.nan, dx)).ffill().to_numpy()
    known = np.where(np.isnan(p), np.nan, np.nan_to_num(known))
    return wilder(known, n)


def stoch_rsi(c, n, fast_k=5, fast_d=3):
    r = pd.Series(rsi(c, n))
    lo, hi = r.rolling(fast_k).min(), r.rolling(fast_k).max()
    k = ratio((100 * (r - lo)).to_numpy(), (hi - lo).to_numpy(), 0.0)
    d = pd.Series(k).rolling(fast_d).mean().to_numpy()
    return np.where(np.isnan(d), np.nan, k), d


def ewm(x, alpha):
    """Exponential average from the first value on; nothing is known after a missing value."""
    out = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy(copy=True)
    out[np.logical_or.accumulate(np.isnan(x))] = np.nan
    return out


def kdj(h, lo, c, n):
    floor, top = pd.Series(lo).rolling(n).min().to_numpy(), pd.Series(h).rolling(n).max().to_numpy()
    rsv = np.nan_to_num(100 * ratio(c - floor, top - floor, np.nan), nan=50.0)
    k = ewm(rsv, 1 / 3)
    d = ewm(k, 1 / 3)
    return k, d, 3 * k - 2 * d


def adosc(h, lo, c, v, fast, slow):
    rng = h - lo
    line = np.cumsum(np.where(rng > 0, ((c - lo) - (h - c)) / np.where(rng > 0, rng, 1) * v, 0.0))
    out = ewm(line, 2 / (fast + 1)) - ewm(line, 2 / (slow + 1))
    out[:slow - 1] = np.nan
    return np.nan_to_num(ratio(out, pd.Series(v).rolling(20).mean().to_numpy(), 0.0))


def trix(c, n):
    e = ema(ema(ema(c, n), n), n)
    prev = np.concatenate([[np.nan], e[:-1]])
    return 100 * (ratio(e, prev) - 1)


def indicator_table(p: dict) -> dict[str, tuple[list[str], Callable]]:
    def c(f):
        return lambda g: [f(g["close"])]
    return {
        "rsi": (["rsi"], c(lambda x: rsi(x, p["rsi"]))),
        "rsi_12": (["rsi_12"], c(lambda x: rsi(x, 12))),
        "cmo": (["cmo"], c(lambda x: cmo(x, p["cmo"]))),
        "stochrsi": (["stochrsi_k", "stochrsi_d"], lambda g: stoch_rsi(g["close"], p["stochrsi"])),
        "kdj": (["kdj_k", "kdj_d", "kdj_j"], lambda g: kdj(g["high"], g["low"], g["close"], p["kdj"])),
        "macd": (["macd", "macd_signal", "macd_hist"], lambda g: [
            ratio(x, g["close"], 0.0) for x in macd(g["close"], p["macd_fast"], p["macd_slow"], p["macd_signal"])]),
        "adx": (["adx"], lambda g: [adx(g["high"], g["low"], g["close"], p["adx"])]),
        "dmi": (["plus_di", "minus_di"], lambda g: directional(g["high"], g["low"], g["close"], p["dmi"])),
        "trix": (["trix"], c(lambda x: trix(x, p["trix"]))),
        "atr": (["atr_abs", "atr"], lambda g: (lambda a: [a, ratio(a, g["close"], 0.0)])(
            wilder(true_range(g["high"], g["low"], g["close"]), p["atr"]))),
        "natr": (["natr"], lambda g: [100 * ratio(
            wilder(true_range(g["high"], g["low"], g["close"]), p["natr"]), g["close"], 0.0)]),
        "adosc": (["adosc"], lambda g: [adosc(g["high"], g["low"], g["close"], g["volume"], p["adosc_fast"], p["adosc_slow"])]),
        "vrsi": (["vrsi"], lambda g: [rsi(g["volume"], p["vrsi"])]),
        "vmacd": (["vmacd", "vmacd_signal"], lambda g: macd(
            g["volume"], p["vmacd_fast"], p["vmacd_slow"], p["vmacd_signal"])[:2]),
    }


ALL = list(indicator_table(PERIODS))


def output_columns(which: Sequence[str] = ALL) -> list[str]:
    table = indicator_table(PERIODS)
    return [c for w in which for c in table[w][0]]
