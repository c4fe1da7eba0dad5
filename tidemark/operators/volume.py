"""Volume operators."""

from __future__ import annotations

from tidemark.functions import kernels as K
from tidemark.operators.registry import operator

CV, HLCV = ("close", "volume"), ("high", "low", "close", "volume")


def rolled(cls, name, requires=CV, period=20):
    """A plain sum of the last ``period`` bars, of what there is before that."""
    return operator(cls, f"volume/{name}", name, norm="z:period", warmup="period", requires=requires, period=period)


@rolled("ObvVolume", "obv")
def _(b, period):
    """Volume by the sign of the change."""
    return (b.change(b.c).f("sign") * b.vol).sum(period, 0)


def location(b):
    """Where the close stands in the bar, -1 to 1; 0 in a bar without range."""
    return (((b.c - b.l) - (b.h - b.c)) / (b.h - b.l)).or_else(0.0)


@rolled("AdVolume", "ad", HLCV)
def _(b, period):
    """Volume by the place of the close in the bar."""
    return (location(b) * b.vol).sum(period, 0)


def _step(b):
    pc = b.c.lag()
    return ((b.c - pc) / pc).or_else(0.0)


@rolled("PvtVolume", "pvt")
def _(b, period):
    """Volume by the relative change."""
    return (_step(b) * b.vol).sum(period, 0)


@rolled("NviVolume", "nvi", period=255)
def _(b, period):
    """Percent changes on falling volume."""
    return (100 * _step(b)).when(b.vol < b.vol.lag(), 0.0).sum(period, 0)


@rolled("PviVolume", "pvi", period=255)
def _(b, period):
    """Percent changes on rising volume."""
    return (100 * _step(b)).when(b.vol > b.vol.lag(), 0.0).sum(period, 0)


def motion(b):
    """Velocity and acceleration of the log price."""
    v = b.log_return(b.c).column()
    return v, v - v.lag()


def dynamic(cls, name, tag, extra=2, **defaults):
    return operator(cls, f"volume/{name}", f"{tag}_{{period}}", norm="z:period", warmup=f"(period+{extra})*5" if extra else "period*5", requires=CV, **(defaults or {"period": 14}))


@dynamic("MarketForceVolume", "market_force", "mforce")
def _(b, period):
    """Mean of volume times acceleration."""
    return (b.vol * motion(b)[1]).column().mean(period, 1).when(b.i >= period + 1)


@dynamic("ImpulseVolume", "impulse", "impulse")
def _(b, period):
    """Sum of volume times acceleration."""
    return (b.vol * motion(b)[1]).column().sum(period, 1).when(b.i >= period + 1)


@dynamic("MarketMomentumVolume", "market_momentum", "mmom", 1)
def _(b, period):
    """Mean of volume times velocity."""
    return (b.vol * motion(b)[0]).column().mean(period, 1).when(b.i >= period)


@dynamic("MarketPowerVolume", "market_power", "mpower")
def _(b, period):
    """Mean of volume times acceleration times velocity."""
    v, a = motion(b)
    return (b.vol * a * v).column().mean(period, 1).when(b.i >= period + 1)


@dynamic("MarketCapacitanceVolume", "market_capacitance", "mcap", 0, period=20)
def _(b, period):
    """Volume per price change over the window."""
    d = (b.c - b.c.lag(period - 1)).abs()
    return (b.vol.sum(period) / d).when(d > 1e-10)


@dynamic("GravitationalPullVolume", "gravitational_pull", "gpull", 0, period=20)
def _(b, period):
    """Volume of earlier bars over the squared log distance to them."""
    rows = b.c.over(f"CASE WHEN count({b.c.sql}) OVER {{w}} >= {period} THEN collect_list(named_struct('c', {b.c.sql}, 'v', {b.vol.sql})) OVER {{w}} END", period)
    gap = f"ln(try_divide({b.c.sql}, v.c))"
    far = f"CASE WHEN v.c > 0 AND {b.c.sql} > 0 AND abs({gap}) > 1e-10 THEN try_divide(v.v, {gap} * {gap}) END"
    return b.sql(f"aggregate(transform(slice({rows.sql}, 1, {period - 1}), v -> coalesce({far}, 0D)), 0D, (s, t) -> s + t)", rows)


@operator("MfiVolume", "volume/mfi", "mfi_{period}", norm=100.0, requires=HLCV, period=14)
def _(b, period):
    """Money flow on rising bars against all, 0 to 100."""
    tp = ((b.h + b.l + b.c) / 3).column()
    d, flow = b.change(tp), tp * b.vol
    up, down = flow.when(d > 0, 0.0).sum(period), flow.when(d < 0, 0.0).sum(period)
    return 100 * up / (up + down)


@operator("CmfVolume", "volume/cmf", "cmf_{period}", norm="z:period", requires=HLCV, period=20)
def _(b, period):
    """Volume by the place of the close, against all volume."""
    return (location(b) * b.vol).sum(period) / b.vol.sum(period)


@operator("EfiVolume", "volume/efi", "efi_{period}", norm="z:period", requires=CV, period=13)
def _(b, period):
    """Average of change times volume."""
    return b.kernel(K.sma_ema, [b.change(b.c) * b.vol], span=period)


@operator("EomVolume", "volume/eom", "eom_{period}", norm="z:period", requires=("high", "low", "volume"), period=14, divisor=100_000_000)
def _(b, period, divisor):
    """How far the middle moves for its volume."""
    move = b.change(((b.h + b.l) / 2).column())
    box = b.vol / float(divisor) / (b.h - b.l + 1e-10)
    return (move / (box + 1e-10)).mean(period)


@operator("KvoVolume", "volume/kvo", "kvo_{fast}_{slow}", "kvo_signal_{signal}", norm="z:slow", warmup="(slow+signal)*5", requires=HLCV, fast=34, slow=55, signal=13)
def _(b, fast, slow, signal):
    """Difference of two averages of signed volume, and its average."""
    flow = [(b.vol * b.change(((b.h + b.l + b.c) / 3).column()).f("sign")).column()]
    line = (b.kernel(K.sma_ema, flow, span=fast) - b.kernel(K.sma_ema, flow, span=slow)).column()
    return line, b.kernel(K.sma_ema, [line], span=signal)


def vwap(b):
    tp = ((b.h + b.l + b.c) / 3).column()
    return tp, (tp * b.vol).sum(None, 0) / (b.vol.sum(None, 0) + 1e-10)


@operator("VwapVolume", "volume/vwap", "vwap", norm="z:20", warmup="100", requires=HLCV)
def _(b):
    """Volume-weighted price since the series began; depends on where it begins."""
    return vwap(b)[1]


@operator("VwapBandsVolume", "volume/vwap_bands", "vwap", "vwap_upper_{period}", "vwap_lower_{period}", norm="z:period", requires=HLCV, period=20, std_dev=2.0)
def _(b, period, std_dev):
    """The volume-weighted price with bands of standard deviations."""
    tp, v = vwap(b)
    sd = std_dev * tp.std(period)
    return v, v + sd, v - sd
