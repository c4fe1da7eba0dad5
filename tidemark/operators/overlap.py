"""Smoothers and price transforms."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions import kernels as K
from tidemark.operators.registry import need, operator

HL, HLC = ("high", "low"), ("high", "low", "close")


def smoother(cls, name, tag, warmup="period*5", check=None, **defaults):
    return operator(cls, f"smooth/{name}", f"{{source_col}}_{tag}_{{period}}", norm="pct", warmup=warmup, check=check, **defaults)


@smoother("KamaSmooth", "kama", "kama", warmup="period*100", period=10, fast=2, slow=30)
def _(b, source_col, period, fast, slow):
    """Adapts to how straight the price moves."""
    x = b.col(source_col)
    way = (x - x.lag()).abs().sum(period, period)
    er = ((x - x.lag(period)).abs() / way).or_else(0.0)
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    gain = (er * (f - s) + s).sq()
    return b.kernel(K.varying, [x, gain, x.mean(period).when(b.i.eq(period - 1))])


@smoother("AlmaSmooth", "alma", "alma", warmup="period*3", period=10, offset=0.85, sigma=6.0)
def _(b, source_col, period, offset, sigma):
    """Gaussian weights around ``offset``."""
    k = np.arange(period)
    w = np.exp(-((k - offset * (period - 1)) ** 2) / (2 * (period / sigma) ** 2))
    return b.col(source_col).fir(w / w.sum())


@smoother("JmaSmooth", "jma", "jma", warmup="period*10+65", period=7, phase=0)
def _(b, source_col, period, phase):
    """Adapts to relative volatility in three stages."""
    return b.kernel(K.jma, [b.col(source_col)], period=period, phase=phase)


@smoother("VidyaSmooth", "vidya", "vidya", period=14)
def _(b, source_col, period):
    """An average whose speed follows the strength of the trend."""
    x = b.col(source_col)
    d = x - x.lag()
    up, down = b.greatest(d, 0.0).when(d.known()).sum(period), b.greatest(-d, 0.0).when(d.known()).sum(period)
    speed = ((up - down) / (up + down)).abs().or_else(0.0) * (2 / (period + 1))
    return b.kernel(K.varying, [x, speed, x.mean(period + 1).when(b.i.eq(period))])


@smoother("T3Smooth", "t3", "t3", warmup="period*6", period=10, vfactor=0.7)
def _(b, source_col, period, vfactor):
    """A blend of the third to sixth average of averages."""
    e, made = b.col(source_col), []
    for _ in range(6):
        e = b.kernel(K.sma_ema, [e], span=period)
        made.append(e)
    v = vfactor
    # (1 + v - v D)^3 applied to the third average, D one average more
    w = [(1 + v) ** 3, -3 * v * (1 + v) ** 2, 3 * v * v * (1 + v), -(v**3)]
    return w[0] * made[2] + w[1] * made[3] + w[2] * made[4] + w[3] * made[5]


@smoother("ZlmaSmooth", "zlma", "zlma", period=20, ma_type="ema")
def _(b, source_col, period, ma_type):
    """An average of the price with its lag taken out."""
    x = b.col(source_col)
    ahead = (2 * x - x.lag((period - 1) // 2)).column()
    return ahead.mean(period) if ma_type == "sma" else b.kernel(K.first_ema, [ahead], span=period)


@smoother("McGinleySmooth", "mcginley", "mcg", period=10, k=0.6)
def _(b, source_col, period, k):
    """Speeds up where the price runs away."""
    return b.kernel(K.mcginley, [b.col(source_col)], period=period, k=k)


@smoother("FramaSmooth", "frama", "frama", check=lambda period, **_: need(period % 2 == 0, "period must be even"), period=16)
def _(b, source_col, period):
    """An average whose speed follows the fractal dimension."""
    x, half = b.col(source_col), period // 2
    hi, lo = x.max(half).column(), x.min(half).column()
    late = (hi - lo) / half
    early = (hi.lag(half) - lo.lag(half)) / half
    whole = (x.max(period) - x.min(period)) / period
    dim = ((early + late).ln() - whole.ln()) / math.log(2)
    dim = dim.when((early + late > 0) & (whole > 0)).or_else(1.0)
    gain = b.least(b.greatest((-4.6 * (dim - 1)).f("exp"), 0.01), 1.0)
    return b.kernel(K.varying, [x, gain, x.when(b.i.eq(period - 1))])


def price(cls, name, out, requires, **defaults):
    return operator(cls, f"price/{name}", out, warmup="period*5" if "period" in defaults else "100", requires=requires, **defaults)


@price("Hl2Price", "hl2", "hl2", HL)
def _(b):
    """Middle of the range."""
    return (b.h + b.l) / 2


@price("Hlc3Price", "hlc3", "hlc3", HLC)
def _(b):
    """Mean of high, low and close."""
    return (b.h + b.l + b.c) / 3


@price("Ohlc4Price", "ohlc4", "ohlc4", ("open", "high", "low", "close"))
def _(b):
    """Mean of all four prices."""
    return (b.o + b.h + b.l + b.c) / 4


@price("WcpPrice", "wcp", "wcp", HLC)
def _(b):
    """Mean with the close counted twice."""
    return (b.h + b.l + 2 * b.c) / 4


@price("TypicalPrice", "typical", "typical", HLC, weight_high=1.0, weight_low=1.0, weight_close=1.0)
def _(b, weight_high, weight_low, weight_close):
    """Weighted mean of high, low and close."""
    return (weight_high * b.h + weight_low * b.l + weight_close * b.c) / (weight_high + weight_low + weight_close)


@price("MidpointPrice", "midpoint", "{source_col}_midpoint_{period}", ("{source_col}",), period=14)
def _(b, source_col, period):
    """Middle of the source's own range."""
    x = b.col(source_col)
    return (x.max(period) + x.min(period)) / 2


@price("MidpricePrice", "midprice", "midprice_{period}", HL, period=14)
def _(b, period):
    """Middle of highest high and lowest low."""
    return (b.h.max(period) + b.l.min(period)) / 2


@price("LogPrice", "log_price", "{source_col}_log", ("{source_col}",))
def _(b, source_col):
    """Natural logarithm."""
    return b.col(source_col).ln()


@price("PctFromHighPrice", "pct_from_high", "{source_col}_pct_from_high_{period}", ("{source_col}",), period=20)
def _(b, source_col, period):
    """Percent below the highest."""
    x = b.col(source_col)
    top = x.max(period)
    return (x - top) / top * 100


@price("PctFromLowPrice", "pct_from_low", "{source_col}_pct_from_low_{period}", ("{source_col}",), period=20)
def _(b, source_col, period):
    """Percent above the lowest."""
    x = b.col(source_col)
    low = x.min(period)
    return (x - low) / low * 100


@smoother("SmaSmooth", "sma", "sma", warmup="period*3", period=20)
def _(b, source_col, period):
    """Moving average."""
    return b.col(source_col).mean(period)


def _chain(b, source_col, span, times):
    e, made = b.col(source_col), []
    for _ in range(times):
        e = b.kernel(K.first_ema, [e], span=span)
        made.append(e)
    return made


@smoother("EmaSmooth", "ema", "ema", period=20)
def _(b, source_col, period):
    """Exponential average that starts with the first value."""
    return _chain(b, source_col, period, 1)[0]


def linear_weights(p):
    k = np.arange(1, p + 1)
    return k / k.sum()


@smoother("WmaSmooth", "wma", "wma", warmup="period*3", period=20)
def _(b, source_col, period):
    """Weights 1 to ``period``."""
    return b.col(source_col).fir(linear_weights(period))


@smoother("RmaSmooth", "rma", "rma", warmup="period*10", period=14)
def _(b, source_col, period):
    """Wilder's average that starts with the first value."""
    return _chain(b, source_col, 2 * period - 1, 1)[0]


@smoother("DemaSmooth", "dema", "dema", period=20)
def _(b, source_col, period):
    """Twice an average less its average."""
    e1, e2 = _chain(b, source_col, period, 2)
    return 2 * e1 - e2


@smoother("TemaSmooth", "tema", "tema", warmup="period*6", period=20)
def _(b, source_col, period):
    """The triple form of DEMA."""
    e1, e2, e3 = _chain(b, source_col, period, 3)
    return 3 * e1 - 3 * e2 + e3


@smoother("HmaSmooth", "hma", "hma", warmup="period*3", period=20)
def _(b, source_col, period):
    """Hull's average: weights of weights, folded into one filter."""
    half, root = period // 2, int(math.sqrt(period))
    inner = -linear_weights(period)
    inner[period - half :] += 2 * linear_weights(half)
    return b.col(source_col).fir(np.convolve(inner, linear_weights(root)))


@smoother("TrimaSmooth", "trima", "trima", warmup="period*3", period=20)
def _(b, source_col, period):
    """Average of an average."""
    half = math.ceil((period + 1) / 2)
    return b.col(source_col).mean(half).mean(half)


@smoother("SwmaSmooth", "swma", "swma", warmup="period*3", period=4)
def _(b, source_col, period):
    """Symmetric weights."""
    k = np.arange(1, period + 1)
    w = np.minimum(k, k[::-1]).astype(float)
    return b.col(source_col).fir(w / w.sum())


@smoother("SsfSmooth", "ssf", "ssf", warmup="period*3", period=10, poles=2)
def _(b, source_col, period, poles):
    """Low-pass filter of two or three poles."""
    return b.kernel(K.super_smoother, [b.col(source_col)], period=period, poles=poles)


def line_matrix(p):
    """The least-squares line of a window, as a matrix."""
    t = np.stack([np.ones(p), np.arange(p) - (p - 1) / 2], 1)
    return t @ np.linalg.solve(t.T @ t, t.T)


def _check_fft(period, cutoff_ratio, **_):
    need(0 < cutoff_ratio <= 1, "cutoff_ratio must be over 0 and at most 1")
    need(period >= 4, "period must be at least 4")


@smoother("FftSmooth", "fft", "fft", warmup="period*3", check=_check_fft, period=64, cutoff_ratio=0.1)
def _(b, source_col, period, cutoff_ratio):
    """Low frequencies around the window's line; linear, so one filter."""
    fit = line_matrix(period)
    keep = max(1, round(period // 2 * cutoff_ratio))
    waves = np.fft.rfft(np.eye(period) - fit, axis=0)
    waves[keep + 1 :] = 0
    return b.col(source_col).fir((np.fft.irfft(waves, n=period, axis=0) + fit)[-1])
