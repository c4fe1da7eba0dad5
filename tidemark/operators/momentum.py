"""Momentum operators."""

from __future__ import annotations

from tidemark.functions import kernels as K
from tidemark.operators.registry import operator

CLOSE, HLC, HL = ("close",), ("high", "low", "close"), ("high", "low")


def rsi(b, period):
    d = b.change(b.c)
    up = b.kernel(K.rma, [b.greatest(d, 0.0)], period=period)
    down = b.kernel(K.rma, [b.greatest(-d, 0.0)], period=period)
    return 100 - 100 / (1 + up / (down + 1e-10))


@operator("RsiMom", "momentum/rsi", "rsi_{period}", norm=100.0, warmup="period*10", requires=CLOSE, period=14)
def _(b, period):
    """Relative strength: smoothed gains against smoothed losses, 0 to 100."""
    return rsi(b, period)


@operator("RocMom", "momentum/roc", "roc_{period}", norm="z:period", requires=CLOSE, period=10)
def _(b, period):
    """Percent change over ``period`` bars."""
    old = b.c.lag(period)
    return 100 * (b.c - old) / old


@operator("MomMom", "momentum/mom", "mom_{period}", norm="z:period", requires=CLOSE, period=10)
def _(b, period):
    """Change over ``period`` bars."""
    return b.c - b.c.lag(period)


@operator("CmoMom", "momentum/cmo", "cmo_{period}", norm=100.0, requires=CLOSE, period=14)
def _(b, period):
    """Gains less losses as a share of both, -100 to 100."""
    d = b.change(b.c)
    up, down = b.greatest(d, 0.0).sum(period), b.greatest(-d, 0.0).sum(period)
    return 100 * (up - down) / (up + down)


def _log_change(b, x, lag, times):
    v = b.log_return(x, lag)
    for _ in range(times - 1):
        v = v.column()
        v = v - v.lag(lag)
    return v


@operator("AccelerationMom", "momentum/acceleration", "{source_col}_accel_{lag}", norm="z:max(lag * 2, 10)", warmup="(lag * 2 + smooth) * 5", lag=1, smooth=1)
def _(b, source_col, lag, smooth):
    """Second difference of the log price."""
    a = _log_change(b, b.col(source_col), lag, 2)
    return a.mean(smooth) if smooth > 1 else a


@operator("JerkMom", "momentum/jerk", "{source_col}_jerk_{lag}", norm="z:max(lag * 3, 10)", warmup="(lag * 3 + smooth) * 5", lag=1, smooth=1)
def _(b, source_col, lag, smooth):
    """Third difference of the log price."""
    a = _log_change(b, b.col(source_col), lag, 3)
    return a.mean(smooth) if smooth > 1 else a


def displacement(b, x, ma_period):
    """Log distance from the moving average."""
    return (b.log_floor(x) - b.log_floor(x.mean(ma_period))).column()


def _angular(b, x, period, ma_period):
    moment = (displacement(b, x, ma_period) * b.log_return(x)).column()
    return moment.mean(period, 1).when(b.i >= max(ma_period, period))


@operator("AngularMomentumMom", "momentum/angular_momentum", "{source_col}_angmom_{period}", norm="z:ma_period", warmup="max(ma_period, period) * 5", period=20, ma_period=50)
def _(b, source_col, period, ma_period):
    """Mean product of displacement and velocity."""
    return _angular(b, b.col(source_col), period, ma_period)


@operator("TorqueMom", "momentum/torque", "{source_col}_torque_{period}", norm="z:ma_period", warmup="(max(ma_period, period) + torque_lag) * 5", period=20, ma_period=50, torque_lag=5)
def _(b, source_col, period, ma_period, torque_lag):
    """Rate of change of the angular momentum."""
    a = _angular(b, b.col(source_col), period, ma_period).column()
    return (a - a.lag(torque_lag)) / torque_lag


def macd(b, fast, slow, signal):
    line = (b.kernel(K.sma_ema, [b.c], span=fast) - b.kernel(K.sma_ema, [b.c], span=slow)).column()
    sig = b.kernel(K.sma_ema, [line], span=signal)
    return line, sig, line - sig


@operator("MacdMom", "momentum/macd", "macd_{fast}_{slow}", "macd_signal_{signal}", "macd_hist_{fast}_{slow}", norm="z:slow", warmup="slow*5", requires=CLOSE, fast=12, slow=26, signal=9)
def _(b, fast, slow, signal):
    """Difference of two averages, its own average, and their distance."""
    return macd(b, fast, slow, signal)


@operator("PpoMom", "momentum/ppo", "ppo_{fast}_{slow}", "ppo_signal_{signal}", "ppo_hist_{fast}_{slow}", norm="z:slow", warmup="slow*5", requires=CLOSE, fast=12, slow=26, signal=9)
def _(b, fast, slow, signal):
    """The difference of two averages in percent of the slow one."""
    f, s = b.kernel(K.sma_ema, [b.c], span=fast), b.kernel(K.sma_ema, [b.c], span=slow)
    line = (100 * (f - s) / (s + 1e-10)).column()
    sig = b.kernel(K.sma_ema, [line], span=signal)
    return line, sig, line - sig


@operator("TsiMom", "momentum/tsi", "tsi_{fast}_{slow}", "tsi_signal_{signal}", norm="z:slow", warmup="(slow+fast)*5", requires=CLOSE, fast=13, slow=25, signal=13)
def _(b, fast, slow, signal):
    """Twice smoothed change against twice smoothed absolute change."""
    d = b.change(b.c)
    up = b.kernel(K.sma_ema, [b.kernel(K.sma_ema, [d], span=slow)], span=fast)
    down = b.kernel(K.sma_ema, [b.kernel(K.sma_ema, [d.abs()], span=slow)], span=fast)
    line = (100 * up / (down + 1e-10)).column()
    return line, b.kernel(K.sma_ema, [line], span=signal)


@operator("TrixMom", "momentum/trix", "trix_{period}", "trix_signal_{signal}", norm="z:period", warmup="period*12", requires=CLOSE, period=18, signal=9)
def _(b, period, signal):
    """Percent change of a triple average."""
    e = b.c
    for _ in range(3):
        e = b.kernel(K.sma_ema, [e], span=period)
    line = (100 * (e / e.lag() - 1)).column()
    return line, b.kernel(K.sma_ema, [line], span=signal)


@operator("StochMom", "momentum/stoch", "stoch_k_{k_period}", "stoch_d_{k_period}", norm=100.0, warmup="(k_period + smooth_k + d_period) * 3", requires=HLC, k_period=14, d_period=3, smooth_k=3)
def _(b, k_period, d_period, smooth_k):
    """Where the close stands in the range, smoothed."""
    lo, hi = b.l.min(k_period), b.h.max(k_period)
    raw = (100 * (b.c - lo) / (hi - lo)).or_else(50.0).when(hi.known()).column()
    k = raw.mean(smooth_k, 1).when(b.i >= k_period + smooth_k - 2).column()
    return k, k.mean(d_period, 1).when(b.i >= k_period + smooth_k + d_period - 3)


@operator("StochRsiMom", "momentum/stochrsi", "stochrsi_k_{rsi_period}", "stochrsi_d_{rsi_period}", norm=100.0, warmup="(rsi_period + stoch_period + k_period + d_period) * 3", requires=CLOSE, rsi_period=14, stoch_period=14, k_period=3, d_period=3)
def _(b, rsi_period, stoch_period, k_period, d_period):
    """Where the relative strength stands in its own range, smoothed."""
    r = rsi(b, rsi_period).column()
    lo, hi = r.min(stoch_period, 2), r.max(stoch_period, 2)
    start = rsi_period + stoch_period - 2
    raw = (100 * (r - lo) / (hi - lo)).or_else(50.0).when(hi.known() & (b.i >= start)).column()
    k = raw.mean(k_period, 1).when(b.i >= start + k_period - 1).column()
    return k, k.mean(d_period, 1).when(b.i >= start + k_period + d_period - 2)


@operator("WillrMom", "momentum/willr", "willr_{period}", norm=lambda x: (x + 100) / 100, warmup="period*3", requires=HLC, period=14)
def _(b, period):
    """How far the close stands below the high of the range, -100 to 0."""
    hi, lo = b.h.max(period), b.l.min(period)
    return (-100 * (hi - b.c) / (hi - lo)).or_else(-50.0).when(hi.known())


@operator("CciMom", "momentum/cci", "cci_{period}", norm="z:period", requires=HLC, period=20, constant=0.015)
def _(b, period, constant):
    """Distance of the typical price from its mean in mean absolute deviations."""
    tp = ((b.h + b.l + b.c) / 3).column()
    mean, a = tp.mean(period), tp.array(period)
    mad = a.each(f"abs(v - {mean.sql})", mean).total() / period
    return ((tp - mean) / (constant * mad)).when(mad > 0)


@operator("UoMom", "momentum/uo", "uo_{fast}_{medium}_{slow}", norm=100.0, warmup="slow*5", requires=HLC, fast=7, medium=14, slow=28, fast_weight=4.0, medium_weight=2.0, slow_weight=1.0)
def _(b, fast, medium, slow, fast_weight, medium_weight, slow_weight):
    """Weighted buying pressure of three horizons, 0 to 100."""
    pc = b.c.lag().or_else(b.c)
    low = b.least(b.l, pc)
    bp, tr = (b.c - low).column(), (b.greatest(b.h, pc) - low).column()
    parts, ok = 0.0, None
    for p, w in ((fast, fast_weight), (medium, medium_weight), (slow, slow_weight)):
        t = tr.sum(p)
        parts = w * (bp.sum(p) / t) + parts
        ok = (t > 0) if ok is None else ok & (t > 0)
    return (100 * parts / (fast_weight + medium_weight + slow_weight)).when(ok & (b.i >= slow - 1))


@operator("AoMom", "momentum/ao", "ao_{fast}_{slow}", norm="z:slow", warmup="slow*5", requires=HL, fast=5, slow=34)
def _(b, fast, slow):
    """Difference of two averages of the middle price."""
    mid = ((b.h + b.l) / 2).column()
    return (mid.mean(fast) - mid.mean(slow)).when(b.i >= slow - 1)
