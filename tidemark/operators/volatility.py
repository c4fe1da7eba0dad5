"""Volatility operators."""

from __future__ import annotations

import math

from tidemark.functions import kernels as K
from tidemark.operators.momentum import displacement
from tidemark.operators.registry import operator

CLOSE, HLC, HL = ("close",), ("high", "low", "close"), ("high", "low")


def average(b, x, kind, period, seed="sma"):
    """Moving average of a kind; recursive ones start with the first value or with the mean of the first ``period``."""
    x = x.column()
    if kind == "rma":
        return b.kernel(K.rma, [x], period=period)
    if kind == "ema":
        return b.kernel(K.first_ema if seed == "first" else K.sma_ema, [x], span=period)
    return x.mean(period)


def atr(b, period, kind="rma"):
    return average(b, b.tr, kind, period)


@operator("BollingerVol", "volatility/bollinger", "bb_upper_{period}", "bb_middle_{period}", "bb_lower_{period}", "bb_width_{period}", "bb_pct_{period}", norm="z:period", warmup="period*2", requires=CLOSE, plain=(4,), period=20, std_dev=2.0, ma_type="sma")
def _(b, period, std_dev, ma_type):
    """Bands of standard deviations around an average."""
    mid, sd = average(b, b.c, ma_type, period), b.c.agg("stddev_pop", period)
    up, low = mid + std_dev * sd, mid - std_dev * sd
    return up, mid, low, 100 * (up - low) / mid, (b.c - low) / (up - low + 1e-10)


@operator("KeltnerVol", "volatility/keltner", "kc_upper_{period}", "kc_basis_{period}", "kc_lower_{period}", norm="z:period", requires=HLC, period=20, multiplier=2.0, ma_type="ema", use_true_range=True)
def _(b, period, multiplier, ma_type, use_true_range):
    """Bands of the average range around an average."""
    mid = average(b, b.c, ma_type, period, "first")
    wide = multiplier * average(b, b.tr if use_true_range else b.h - b.l, ma_type, period, "first")
    return mid + wide, mid, mid - wide


@operator("DonchianVol", "volatility/donchian", "dc_upper_{period}", "dc_middle_{period}", "dc_lower_{period}", norm="z:period", requires=HL, period=20)
def _(b, period):
    """Highest high, lowest low and their middle."""
    hi, lo = b.h.max(period), b.l.min(period)
    return hi, (hi + lo) / 2, lo


@operator("AccBandsVol", "volatility/accbands", "accb_upper_{period}", "accb_middle_{period}", "accb_lower_{period}", norm="z:period", requires=HLC, period=20, factor=4.0, ma_type="sma")
def _(b, period, factor, ma_type):
    """Averages of high and low pushed out by the relative range."""
    r = factor * (b.h - b.l) / (b.h + b.l + 1e-10)
    return tuple(average(b, x, ma_type, period, "first") for x in (b.h * (1 + r), b.c, b.l * (1 - r)))


def kinetic(b):
    v = b.log_return(b.c)
    return (0.5 * v * v).column()


def potential(b, ma_period):
    return displacement(b, b.c, ma_period).sq().column()


@operator("KineticEnergyVol", "volatility/kinetic_energy", "ke_{period}", norm="z:period", warmup="(period+1)*5", requires=CLOSE, period=20)
def _(b, period):
    """Mean of half the squared velocity."""
    return kinetic(b).mean(period, 1).when(b.i >= period)


@operator("PotentialEnergyVol", "volatility/potential_energy", "pe_{period}_{ma_period}", norm="z:ma_period", warmup="max(ma_period, period)*5", requires=CLOSE, period=20, ma_period=50)
def _(b, period, ma_period):
    """Mean squared log distance from the average."""
    return potential(b, ma_period).mean(period, 1).when(b.i >= max(ma_period, period) - 1)


def total_energy(b, period, ma_period):
    return (kinetic(b) + potential(b, ma_period)).column().mean(period, 1).when(b.i >= max(ma_period, period) - 1)


@operator("TotalEnergyVol", "volatility/total_energy", "te_{period}_{ma_period}", norm="z:ma_period", warmup="max(ma_period, period)*5", requires=CLOSE, period=20, ma_period=50)
def _(b, period, ma_period):
    """Mean of kinetic and potential energy."""
    return total_energy(b, period, ma_period)


@operator("EnergyFlowVol", "volatility/energy_flow", "eflow_{period}_{ma_period}", norm="z:ma_period", warmup="(max(ma_period, period)+flow_lag)*5", requires=CLOSE, period=20, ma_period=50, flow_lag=5)
def _(b, period, ma_period, flow_lag):
    """Change of the total energy."""
    te = total_energy(b, period, ma_period).column()
    return te - te.lag(flow_lag)


@operator("ElasticStrainVol", "volatility/elastic_strain", "strain_{period}_{ma_period}", norm="z:ma_period", warmup="max(ma_period, period)*5", requires=CLOSE, period=20, ma_period=50)
def _(b, period, ma_period):
    """Mean relative distance from the average."""
    ma = b.c.mean(ma_period)
    strain = ((b.c - ma) / b.greatest(ma, 1e-10)).column()
    return strain.mean(period, 1).when(b.i >= max(ma_period, period) - 1)


def temperature(b, period):
    return (b.log_return(b.c).column().var(period, 3) * period).when(b.i >= period)


@operator("TemperatureVol", "volatility/temperature", "mtemp_{period}", norm="z:period", requires=CLOSE, period=20)
def _(b, period):
    """Variance of log returns times the period."""
    return temperature(b, period)


@operator("HeatCapacityVol", "volatility/heat_capacity", "heatcap_{period}", norm="z:period", warmup="(period+lag)*5", requires=CLOSE, period=20, lag=5)
def _(b, period, lag):
    """Change of temperature per change of kinetic energy."""
    t = temperature(b, period).column()
    e = kinetic(b).mean(period, 1).when(b.i >= period).column()
    d = e - e.lag(lag)
    return ((t - t.lag(lag)) / d).when(d.abs() > 1e-20)


@operator("FreeEnergyVol", "volatility/free_energy", "fenergy_{period}", norm="z:period", requires=CLOSE, period=20, entropy_bins=10)
def _(b, period, entropy_bins):
    """Kinetic energy less temperature times entropy of the returns."""
    v = b.log_return(b.c).column()
    h = b.kernel(K.windowed, [v], name="free_energy", p=period, start=period, least=5, args=(entropy_bins,))
    return kinetic(b).mean(period, 5) - temperature(b, period) * h


@operator("GapVol", "volatility/gap", "gap_val", "gap_pct", "gap_fill_pct", "gap_run_ratio", "gap_range_ratio", "is_gap_up", "is_gap_down", norm="z:20", warmup="20", requires=("open", "high", "low", "close"), plain=(5, 6), min_gap_pct=0.0)
def _(b, min_gap_pct):
    """The gap from the last close, how far it filled, ran, and its share of the range."""
    pc = b.c.lag().or_else(b.o)
    gap = (b.o - pc).column()
    pct = 100 * gap / pc
    safe = b.const(1e-10).when(gap.abs() < 1e-10, gap)
    fill = (100 * (b.o - b.l) / safe).when(gap > 0, (100 * (b.h - b.o) / safe.abs()).when(gap < 0, 0.0))
    wide = b.h - b.l
    return gap, pct, fill, (b.c - b.o) / safe, gap.abs() / b.const(1e-10).when(wide.eq(0), wide), b.const(1.0).when(pct > min_gap_pct, 0.0), b.const(1.0).when(pct < -min_gap_pct, 0.0)


@operator("MassIndexVol", "volatility/mass_index", "massi_{fast}_{slow}", norm="z:slow", warmup="slow*5", requires=HL, fast=9, slow=25)
def _(b, fast, slow):
    """Sum of the range's average against the average of that."""
    x = [(b.h - b.l).column()]
    return (b.kernel(K.first_ema, x, span=fast) / (b.kernel(K.second_ema_from_same, x, span=fast) + 1e-10)).column().sum(slow)


@operator("UlcerIndexVol", "volatility/ulcer_index", "ulcer_{period}", norm="z:period", requires=CLOSE, period=14)
def _(b, period):
    """Root mean square of the drawdowns within the window."""
    a = b.c.array(period)
    deep = b.sql(f"aggregate({a.sql}, named_struct('m', -1e308D, 's', 0D), (q, v) -> named_struct('m', greatest(q.m, v), 's', q.s + coalesce(power(100D * try_divide(v - greatest(q.m, v), greatest(q.m, v)), 2D), 0D)), q -> q.s)", a)
    return (deep / period).sqrt()


@operator("RviVol", "volatility/rvi", "rvi_{period}", norm=100.0, warmup="(std_period+period)*5", requires=CLOSE, period=14, std_period=10)
def _(b, period, std_period):
    """Deviation on rising bars against all."""
    sd, d = b.c.std(std_period), b.change(b.c)
    up = b.kernel(K.sma_ema, [sd.when(d > 0, sd * 0.0)], span=period)
    down = b.kernel(K.sma_ema, [sd.when(d <= 0, sd * 0.0)], span=period)
    return 100 * up / (up + down + 1e-10)


@operator("HistoricalVol", "volatility/historical_vol", "hv_{period}", norm="z:period", requires=CLOSE, period=20, annualize=252)
def _(b, period, annualize):
    """Annualised deviation of log returns."""
    r = (b.c / b.c.lag()).ln().when(b.i > 0, 0.0).column()
    return r.std(period) * math.sqrt(annualize)


@operator("AtrPercentVol", "volatility/atr_percent", "atr_pct_{period}", norm="z:period", requires=HLC, period=14)
def _(b, period):
    """Average true range in percent of the close."""
    return 100 * atr(b, period) / b.c


@operator("TrueRangeVol", "volatility/true_range", "true_range", norm="z:20", warmup="100", requires=HLC)
def _(b):
    """The range from the last close on."""
    return b.tr


@operator("AtrVol", "volatility/atr", "atr_{period}", norm="z:period", requires=HLC, period=14, ma_type="rma")
def _(b, period, ma_type):
    """Average true range."""
    return atr(b, period, ma_type)


@operator("NatrVol", "volatility/natr", "natr_{period}", norm="z:period", requires=HLC, period=14, ma_type="rma")
def _(b, period, ma_type):
    """Average true range in percent of the close."""
    return 100 * atr(b, period, ma_type) / b.c
