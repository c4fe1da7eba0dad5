"""Trend operators."""

from __future__ import annotations

import math

from tidemark.functions import kernels as K
from tidemark.operators.registry import operator
from tidemark.operators.volatility import atr, average
from tidemark.operators.volume import motion

CLOSE, HLC, HL = ("close",), ("high", "low", "close"), ("high", "low")


def middle(b, p):
    return (b.h.max(p) + b.l.min(p)) / 2


@operator("IchimokuTrend", "trend/ichimoku", "tenkan_sen", "kijun_sen", "senkou_a", "senkou_b", norm="z:senkou", warmup="senkou*5", requires=HL, tenkan=9, kijun=26, senkou=52)
def _(b, tenkan, kijun, senkou):
    """Middles of three horizons, two of them shifted by ``kijun`` bars."""
    t, k, s = middle(b, tenkan), middle(b, kijun), middle(b, senkou)
    return t, k, ((t + k) / 2).lag(kijun), s.lag(kijun)


@operator("DpoTrend", "trend/dpo", "dpo_{period}", norm="z:period", requires=CLOSE, period=20)
def _(b, period):
    """Distance from the average half a period ago."""
    return b.c - b.c.mean(period).lag(period // 2 + 1)


@operator("QstickTrend", "trend/qstick", "qstick_{period}", norm="z:period", requires=("open", "close"), period=10, ma_type="sma")
def _(b, period, ma_type):
    """Average of close less open."""
    return average(b, b.c - b.o, ma_type, period)


@operator("TtmTrend", "trend/ttm", "ttm_trend_{period}", norm="z:period", requires=HLC, period=6)
def _(b, period):
    """1 above the average middle, else -1."""
    mean = ((b.h + b.l) / 2).column().mean(period)
    return b.const(1.0).when(b.c > mean, -1.0).when(mean.known())


@operator("AtrTrailingTrend", "trend/atr_trailing", "atr_trail_long_{period}", "atr_trail_short_{period}", "atr_trail_dir_{period}", norm="z:period", requires=HLC, period=14, multiplier=3.0)
def _(b, period, multiplier):
    """Stops a few ranges from the extreme closes, and the side they say."""
    a = multiplier * atr(b, period)
    long, short = (b.c.max(period) - a).column(), (b.c.min(period) + a).column()
    side = b.const(1.0).when(b.c > short, b.const(-1.0).when(b.c < long))
    return long, short, carried(side).or_else(0.0)


def carried(x):
    """The last known value."""
    return x.over(f"last({x.sql}, true) OVER {{w}}", None)


@operator("PsarTrend", "trend/psar", "psar", "psar_dir", norm="z:20", warmup="100", requires=HLC, af=0.02, af_step=0.02, af_max=0.2)
def _(b, af, af_step, af_max):
    """Parabolic stop and reverse. The first row's side depends on the second close."""
    return b.kernel(K.psar, [b.h, b.l, b.c], 2, af=af, step=af_step, most=af_max)


@operator("SupertrendTrend", "trend/supertrend", "supertrend_{period}", "supertrend_dir_{period}", norm="z:period", requires=HLC, period=10, multiplier=3.0)
def _(b, period, multiplier):
    """Ratcheting bands of the average true range."""
    a, mid = multiplier * atr(b, period), (b.h + b.l) / 2
    return b.kernel(K.supertrend, [b.c, mid + a, mid - a], 2)


@operator("ChandelierTrend", "trend/chandelier", "chandelier_long_{period}", "chandelier_short_{period}", norm="z:period", requires=HLC, period=22, multiplier=3.0)
def _(b, period, multiplier):
    """Stops a few average ranges from the extremes."""
    a = multiplier * b.tr.column().mean(period)
    return b.h.max(period) - a, b.l.min(period) + a


@operator("HiloTrend", "trend/hilo", "hilo", "hilo_dir", norm="z:max(high_period, low_period)", warmup="max(high_period, low_period)*5", requires=HLC, high_period=13, low_period=21, ma_type="sma")
def _(b, high_period, low_period, ma_type):
    """The average low above, the average high below; kept in between."""
    top, bottom = average(b, b.h, ma_type, high_period, "first").column(), average(b, b.l, ma_type, low_period, "first").column()
    on = b.i >= max(high_period, low_period)
    side = b.const(1.0).when(b.c > top.lag(), b.const(-1.0).when(b.c < bottom.lag())).when(on)
    line = bottom.when(side.eq(1.0), top.when(side.eq(-1.0)))
    return carried(line), carried(side).or_else(0.0)


@operator("CkspTrend", "trend/cksp", "cksp_long", "cksp_short", norm="z:p + q", warmup="(p+q)*5", requires=HLC, p=10, x=1.0, q=9)
def _(b, p, x, q):
    """Chande-Kroll stops."""
    a = x * atr(b, p)
    long, short = (b.h.max(p) - a).column(), (b.l.min(p) + a).column()
    on = b.i >= p + q - 2
    return long.max(q, 1).when(on), short.min(q, 1).when(on)


@operator("AdxTrend", "trend/adx", "adx_{period}", "dmp_{period}", "dmn_{period}", norm=100.0, requires=HLC, period=14)
def _(b, period):
    """Strength of the trend and its two sides, 0 to 100."""
    up, down = (b.h - b.h.lag()).or_else(0.0), (b.l.lag() - b.l).or_else(0.0)
    plus, minus = (x.when((x > y) & (x > 0), 0.0) for x, y in ((up, down), (down, up)))
    smooth = [b.kernel(K.rma, [x], period=period) for x in (b.tr, plus, minus)]
    p, m = 100 * smooth[1] / smooth[0], 100 * smooth[2] / smooth[0]
    dx = (100 * (p - m).abs() / (p + m + 1e-10)).column()
    seed = dx.mean(period, 1).when(b.i.eq(2 * period - 1))
    return b.kernel(K.gated_ema, [dx, seed], alpha=1 / period), p, m


@operator("AroonTrend", "trend/aroon", "aroon_up_{period}", "aroon_dn_{period}", "aroon_osc_{period}", norm=100.0, requires=HL, period=25, textbook=False)
def _(b, period, textbook):
    """Bars since the extremes in percent of the period; ``textbook`` counts from the other end."""
    hi, lo = b.h.array(period + 1), b.l.array(period + 1)
    since = lambda a, best: a._mix(f"CAST(array_position(reverse({a.sql}), {best}({a.sql})) - 1 AS double)")
    up, down = 100 * since(hi, "array_max") / period, 100 * since(lo, "array_min") / period
    if textbook:
        up, down = 100 - up, 100 - down
    return up, down, up - down


@operator("VortexTrend", "trend/vortex", "vi_plus_{period}", "vi_minus_{period}", norm="z:period", requires=HLC, period=14)
def _(b, period):
    """Upward and downward movement against the true range."""
    up, down = (b.h - b.l.lag()).abs().or_else(0.0), (b.l - b.h.lag()).abs().or_else(0.0)
    tr = b.tr.column().sum(period)
    return (up.sum(period) / tr).when(tr > 0), (down.sum(period) / tr).when(tr > 0)


@operator("VhfTrend", "trend/vhf", "vhf_{period}", norm="z:period", requires=CLOSE, period=28)
def _(b, period):
    """Range of closes against the way they went."""
    return (b.c.max(period) - b.c.min(period)) / b.change(b.c).abs().sum(period)


@operator("ChopTrend", "trend/chop", "chop_{period}", norm=100.0, requires=HLC, period=14)
def _(b, period):
    """Log share of the true ranges in the whole range, 0 to 100."""
    wide = b.h.max(period) - b.l.min(period)
    return (100 / math.log(period) * (b.tr.column().sum(period) / wide).ln()).when(wide > 0)


@operator("ViscosityTrend", "trend/viscosity", "viscosity_{period}", norm="z:period", warmup="(period+2)*5", requires=CLOSE, period=20)
def _(b, period):
    """Mean absolute acceleration against mean absolute velocity."""
    v, a = motion(b)
    way = v.abs().mean(period, 1)
    return (a.abs().mean(period, 1) / way).when((way > 1e-10) & (b.i >= period + 1))


@operator("ReynoldsTrend", "trend/reynolds", "reynolds_{period}", norm="z:period", requires=CLOSE, period=20)
def _(b, period):
    """Drift times period against deviation."""
    v = motion(b)[0]
    sd = v.std(period, 3)
    return (v.mean(period, 3).abs() * period / sd).when((sd > 1e-10) & (b.i >= period))


@operator("RotationalInertiaTrend", "trend/rotational_inertia", "rot_inertia_{period}", norm="z:period", requires=("close", "volume"), period=20)
def _(b, period):
    """Volume by squared log distance from the window's average."""
    ma = b.c.mean(period)
    m = ma.ln().column()
    x, v = b.log_floor(b.c).array(period), b.vol.array(period)  # expanded, the square would cancel where prices hardly move
    return x._mix(f"aggregate(zip_with({x.sql}, {v.sql}, (s, t) -> t * (s - {m.sql}) * (s - {m.sql})), 0D, (s, t) -> s + t)", v, m).when(ma > 1e-10)


@operator("MarketImpedanceTrend", "trend/market_impedance", "impedance_{period}", norm="z:period", requires=("high", "low", "volume"), period=20)
def _(b, period):
    """Range per volume."""
    v = b.vol.sum(period)
    return ((b.h - b.l).sum(period) / v).when(v > 1e-10)


@operator("RCTimeConstantTrend", "trend/rc_time_constant", "rc_tau_{period}", norm="z:period", requires=HLC, period=20)
def _(b, period):
    """Range per price change over the window."""
    d = (b.c - b.c.lag(period - 1)).abs()
    return ((b.h - b.l).sum(period) / d).when(d > 1e-10)


@operator("SNRTrend", "trend/snr", "snr_{period}", norm="z:period", requires=CLOSE, period=20)
def _(b, period):
    """Squared mean against variance of the velocity."""
    v = motion(b)[0]
    var = v.var(period, 3)
    return (v.mean(period, 3).sq() / var).when((var > 1e-15) & (b.i >= period))


def order_parameter(b, period):
    pc = b.c.lag()
    sign = (b.c - pc).f("sign").when(pc > 0).column()
    return sign.mean(period, 1).abs().when(b.i >= period)


@operator("OrderParameterTrend", "trend/order_parameter", "order_param_{period}", norm=1.0, requires=CLOSE, period=20)
def _(b, period):
    """Absolute mean direction, 0 to 1."""
    return order_parameter(b, period)


@operator("SusceptibilityTrend", "trend/susceptibility", "susceptibility_{period}", norm="z:chi_window", warmup="(period+chi_window)*5", requires=CLOSE, period=20, chi_window=50)
def _(b, period, chi_window):
    """Variance of the order parameter times the period."""
    return (order_parameter(b, period).column().var(chi_window, 3) * period).when(b.i >= period + chi_window - 1)
