"""Statistics of moving windows: dispersion, distribution, memory, regression, realised volatility."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions import kernels as K
from tidemark.operators.momentum import displacement
from tidemark.operators.overlap import line_matrix
from tidemark.operators.registry import need, operator


def stat(cls, name, tag, norm=None, warmup="period*5", check=None, **defaults):
    return operator(cls, f"stat/{name}", f"{{source_col}}_{tag}_{{period}}", norm=norm, warmup=warmup, check=check, **defaults)


def nearest(x, p, q):
    """The quantile ``q`` of the window: the value whose rank is nearest, halves away from 0."""
    return x.sorted(p).f("element_at", int(math.floor((p - 1) * q + 0.5)) + 1)


def median_of(a, p):
    """The median of a sorted array of ``p``."""
    lo, hi = (p - 1) // 2 + 1, p // 2 + 1
    return (a.f("element_at", lo) + a.f("element_at", hi)) / 2


# dispersion


@stat("VarianceStat", "variance", "var", period=30, ddof=1)
def _(b, source_col, period, ddof):
    """Variance."""
    x = b.col(source_col)
    return x.agg("var_pop", period) * (period / (period - ddof)) if ddof not in (0, 1) else x.agg("var_samp" if ddof else "var_pop", period)


@stat("StdStat", "std", "std", period=30, ddof=1)
def _(b, source_col, period, ddof):
    """Standard deviation."""
    x = b.col(source_col)
    return x.agg("stddev_pop", period) * math.sqrt(period / (period - ddof)) if ddof not in (0, 1) else x.agg("stddev_samp" if ddof else "stddev_pop", period)


@stat("MadStat", "mad", "mad", period=30)
def _(b, source_col, period):
    """Mean absolute deviation from the mean."""
    x = b.col(source_col)
    mean = x.mean(period)
    return x.array(period).each(f"abs(v - {mean.sql})", mean).total() / period


@stat("ZscoreStat", "zscore", "zscore", period=30)
def _(b, source_col, period):
    """Distance from the mean in standard deviations."""
    x = b.col(source_col)
    return (x - x.mean(period)) / x.std(period)


@stat("CvStat", "cv", "cv", period=30)
def _(b, source_col, period):
    """Standard deviation against the mean's size."""
    x = b.col(source_col)
    return x.std(period) / x.mean(period).abs()


@stat("RangeStat", "range", "range", period=30)
def _(b, source_col, period):
    """Maximum less minimum."""
    x = b.col(source_col)
    return x.max(period) - x.min(period)


@stat("IqrStat", "iqr", "iqr", period=30)
def _(b, source_col, period):
    """Distance of the quartiles (nearest ranks)."""
    x = b.col(source_col)
    return nearest(x, period, 0.75) - nearest(x, period, 0.25)


@stat("AadStat", "aad", "aad", period=30)
def _(b, source_col, period):
    """Mean absolute deviation from the median."""
    a = b.col(source_col).sorted(period).column()
    mid = median_of(a, period).column()
    a2 = a._mix(a.sql, mid)
    return a2.each(f"abs(v - {mid.sql})", mid).total() / period


@stat("RobustZscoreStat", "robust_zscore", "robz", period=30)
def _(b, source_col, period):
    """Distance from the median in scaled median deviations."""
    x = b.col(source_col)
    a = x.sorted(period).column()
    mid = median_of(a, period).column()
    off = a._mix(a.sql, mid).each(f"abs(v - {mid.sql})", mid).f("array_sort").column()
    mad = 1.4826 * median_of(off, period)
    return ((x - mid) / mad).when(mad > 1e-10)


# distribution


@stat("MedianStat", "median", "median", period=30)
def _(b, source_col, period):
    """Median."""
    return median_of(b.col(source_col).sorted(period), period)


@operator("QuantileStat", "stat/quantile", "{source_col}_q{q}_{period}", check=lambda q, **_: need(0 < q < 1, "q must be between 0 and 1"), period=30, q=0.5)
def _(b, source_col, period, q):
    """Quantile (nearest rank)."""
    return nearest(b.col(source_col), period, q)


@stat("PctRankStat", "pctrank", "pctrank", period=30)
def _(b, source_col, period):
    """Percent of the window below the last value."""
    x = b.col(source_col)
    a = x.array(period)
    return a._mix(f"size(filter({a.sql}, v -> v < {x.sql}))").when(a.known()) / period * 100


@stat("MinMaxStat", "minmax", "minmax", period=30)
def _(b, source_col, period):
    """Place between minimum and maximum, 0 to 1."""
    x = b.col(source_col)
    lo = x.min(period)
    return (x - lo) / (x.max(period) - lo)


@stat("SkewStat", "skew", "skew", period=30)
def _(b, source_col, period):
    """Skewness, corrected for bias."""
    n = period
    return b.col(source_col).agg("skewness", n) * (math.sqrt(n * (n - 1)) / (n - 2))


@stat("KurtosisStat", "kurtosis", "kurt", period=30)
def _(b, source_col, period):
    """Excess kurtosis of the window itself."""
    return b.col(source_col).agg("kurtosis", period)


def share_entropy(b, x, period, base):
    """Entropy of the values' shares in their sum."""
    total = x.sum(period)
    logs = (x * x.ln()).when(x > 0, 0.0).sum(period)
    return ((total.ln() - logs / total) / math.log(base)).when(total > 0)


@stat("EntropyStat", "entropy", "entropy", period=10, base=2.0)
def _(b, source_col, period, base):
    """Entropy of the values' shares in their sum."""
    return share_entropy(b, b.col(source_col), period, base)


@stat("JarqueBeraStat", "jarque_bera", "jb", period=30)
def _(b, source_col, period):
    """Distance from a normal distribution by skewness and kurtosis."""
    x, n = b.col(source_col), period
    r = (n - 1) / n
    s, k = x.agg("skewness", n) * r**1.5, (x.agg("kurtosis", n) + 3) * r**2 - 3
    return (n / 6 * (s * s + k * k / 4)).when(x.std(n) > 1e-10)


@stat("ModeDistanceStat", "mode_distance", "mode_dist", period=30, n_bins=10)
def _(b, source_col, period, n_bins):
    """Distance from the middle of the fullest of ``n_bins`` bins."""
    return b.kernel(K.windowed, [b.col(source_col)], name="mode_distance", p=period, start=period - 1, least=period, args=(n_bins,))


@stat("AboveMeanRatioStat", "above_mean_ratio", "above_mean", period=30)
def _(b, source_col, period):
    """Share of the window above its mean."""
    x = b.col(source_col)
    mean, a = x.mean(period), x.array(period)
    return a._mix(f"size(filter({a.sql}, v -> v > {mean.sql}))", mean).when(a.known()) / period


@stat("EntropyRateStat", "entropy_rate", "entropy_rate", norm="z:period", warmup="(period+lag)*5", period=10, lag=5, base=2.0)
def _(b, source_col, period, lag, base):
    """Change of the share entropy per bar."""
    h = share_entropy(b, b.col(source_col), period, base).column()
    return (h - h.lag(lag)) / lag


# memory


@stat("HurstStat", "hurst", "hurst", check=lambda period, **_: need(period >= 20, "period must be at least 20"), period=100)
def _(b, source_col, period):
    """Rescaled range exponent of the window."""
    return b.kernel(K.windowed, [b.col(source_col)], name="hurst", p=period, start=period - 1, least=period)


@operator("AutocorrStat", "stat/autocorr", "{source_col}_acf{lag}_{period}", warmup="(period+lag)*5", period=30, lag=1)
def _(b, source_col, period, lag):
    """Correlation with the window ``lag`` bars before; 0 where there is none."""
    x = b.col(source_col)
    y = x.lag(lag)
    r = x._mix(x.sql, y).agg("corr", period, 0, y)
    return r.or_else(0.0).when(y.sum(period).known() & x.sum(period).known())


@operator("VarianceRatioStat", "stat/variance_ratio", "{source_col}_vr{k}_{period}", warmup="(period+k)*5", period=50, k=5)
def _(b, source_col, period, k):
    """Variance of ``k``-bar changes against that of one-bar changes."""
    x = b.col(source_col)
    one, many = (x / x.lag()).ln().column(), (x / x.lag(k)).ln().column()
    v1 = one.var(period, 2)
    return (many.var(period - k, 2) / (k * v1)).when((v1 > 1e-10) & (b.i >= period + k - 1))


@stat("DiffusionCoeffStat", "diffusion_coeff", "diffcoeff", norm="z:period", period=30)
def _(b, source_col, period):
    """Half the variance of log returns."""
    return (b.log_return(b.col(source_col)).column().var(period, 3) / 2).when(b.i >= period)


def msd(b, x, tau, period):
    """Mean squared displacement over ``tau`` bars within the window."""
    y = b.log_floor(x).column()
    return (y - y.lag(tau)).sq().column().mean(period - tau)


@stat("AnomalousDiffusionStat", "anomalous_diffusion", "adiff", norm="z:period", warmup="(period+tau_long)*5", check=lambda tau_short, tau_long, **_: need(tau_long > tau_short, "tau_long must be over tau_short"), period=60, tau_short=1, tau_long=10)
def _(b, source_col, period, tau_short, tau_long):
    """How fast displacement grows with time."""
    s, t = msd(b, b.col(source_col), tau_short, period), msd(b, b.col(source_col), tau_long, period)
    return ((t / s).ln() / math.log(tau_long / tau_short)).when((s > 1e-20) & (t > 1e-20) & (b.i >= period + tau_long - 1))


@stat("MsdRatioStat", "msd_ratio", "msdr", norm="z:period", warmup="(period+2*tau)*5", period=60, tau=5)
def _(b, source_col, period, tau):
    """Squared displacement over twice the time against that over the time."""
    s, t = msd(b, b.col(source_col), tau, period), msd(b, b.col(source_col), 2 * tau, period)
    return (t / s).when((s > 1e-20) & (b.i >= period + 2 * tau - 1))


def oscillation(b, x, period, ma_period):
    """Displacement, and the slope of its change on it; both from row max(ma_period, period) on."""
    d = displacement(b, x, ma_period)
    old = d.lag()
    both = old.known() & d.known()
    move = (d - old).when(both)
    n = period - 1
    slope = move.column().agg("regr_slope", n, 6, old)
    spread = old._mix(old.sql, move).when(both).column().agg("var_pop", n, 6) * n
    return d, old, move, slope.when((spread > 1e-20) & (b.i >= max(ma_period, period)))


@stat("SpringConstantStat", "spring_constant", "spring_k", norm="z:period", warmup="max(ma_period, period)*5", period=60, ma_period=50)
def _(b, source_col, period, ma_period):
    """How strongly displacement pulls back."""
    return -oscillation(b, b.col(source_col), period, ma_period)[3]


@stat("DampingRatioStat", "damping_ratio", "damping", norm="z:period", warmup="max(ma_period, period)*5", period=60, ma_period=50)
def _(b, source_col, period, ma_period):
    """Mean log decrement of the displacement's peaks, as a damping ratio."""
    d = displacement(b, b.col(source_col), ma_period)
    return b.kernel(K.windowed, [d], name="damping", p=period, start=max(ma_period, period), least=10)


@stat("NaturalFrequencyStat", "natural_frequency", "natfreq", norm="z:period", warmup="max(ma_period, period)*5", period=60, ma_period=50)
def _(b, source_col, period, ma_period):
    """Sign changes of the displacement per bar, times pi."""
    x = b.col(source_col)
    return b.kernel(K.windowed, [(x - x.mean(ma_period)).column()], name="crossings", p=period, start=max(ma_period, period), least=4)


@stat("PlasticStrainStat", "plastic_strain", "plastic", norm="z:period", warmup="max(ma_period, period)*5", period=60, ma_period=50)
def _(b, source_col, period, ma_period):
    """1 less the correlation of displacement and pull back."""
    _, old, move, _ = oscillation(b, b.col(source_col), period, ma_period)
    back = (-move).column()
    r = back.agg("corr", period - 1, 6, old)
    return (1 - b.greatest(r, 0.0)).when(r.known() & (b.i >= max(ma_period, period)))


@stat("EscapeVelocityStat", "escape_velocity", "vesc", norm="z:period", warmup="max(ma_period, period)*5", period=60, ma_period=50)
def _(b, source_col, period, ma_period):
    """Velocity against what leaves the pull of the average."""
    x = b.col(source_col)
    d, _, _, slope = oscillation(b, x, period, ma_period)
    k = b.greatest(-slope, 1e-20).when(slope.known())
    escape = (2 * k * d.abs()).sqrt()
    return (b.log_return(x).abs() / escape).when((d.abs() > 1e-10) & (escape > 1e-20))


@stat("CorrelationLengthStat", "correlation_length", "corrlen", norm="z:period", warmup="(period+max_lag)*5", period=100, max_lag=20)
def _(b, source_col, period, max_lag):
    """First lag at which the returns' correlation is not positive."""
    v = b.log_return(b.col(source_col)).column()
    return b.kernel(K.windowed, [v], name="correlation_length", p=period, start=period + max_lag - 1, least=max_lag + 5, args=(max_lag,))


# realised volatility


def realized(cls, name, tag, requires, **defaults):
    return operator(cls, f"stat/{name}", f"{tag}_{{period}}", requires=requires, **(defaults or {"period": 30}), annualize=True, trading_periods=252)


def yearly(x, annualize, trading_periods):
    return x * math.sqrt(trading_periods) if annualize else x


@realized("RealizedVolStat", "realized_vol", "realized_vol", ("close",))
def _(b, period, annualize, trading_periods):
    """Root mean square of log returns."""
    r = (b.c / b.c.lag()).ln().column()
    return yearly(((r * r).sum(period) / period).sqrt(), annualize, trading_periods)


@realized("ParkinsonVolStat", "parkinson_vol", "parkinson_vol", ("high", "low"))
def _(b, period, annualize, trading_periods):
    """From the ranges."""
    r = (b.h / b.l).ln()
    return yearly(((r * r).sum(period) / (4 * math.log(2) * period)).sqrt(), annualize, trading_periods)


@realized("GarmanKlassVolStat", "garman_klass_vol", "gk_vol", ("open", "high", "low", "close"))
def _(b, period, annualize, trading_periods):
    """From ranges and bodies."""
    x = 0.5 * (b.h / b.l).ln().sq() - (2 * math.log(2) - 1) * (b.c / b.o).ln().sq()
    m = x.mean(period)
    return yearly(b.greatest(m, 0.0).when(m.known()).sqrt(), annualize, trading_periods)


def rogers_satchell(b):
    return (b.h / b.c).ln() * (b.h / b.o).ln() + (b.l / b.c).ln() * (b.l / b.o).ln()


@realized("RogersSatchellVolStat", "rogers_satchell_vol", "rs_vol", ("open", "high", "low", "close"))
def _(b, period, annualize, trading_periods):
    """From ranges, free of drift."""
    m = rogers_satchell(b).mean(period)
    return yearly(b.greatest(m, 0.0).when(m.known()).sqrt(), annualize, trading_periods)


@realized("YangZhangVolStat", "yang_zhang_vol", "yz_vol", ("open", "high", "low", "close"))
def _(b, period, annualize, trading_periods):
    """From gaps, bodies and ranges."""
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    night = (b.o / b.c.lag()).ln().column().var(period)
    m = rogers_satchell(b).mean(period)
    total = night + k * (b.c / b.o).ln().var(period) + (1 - k) * b.greatest(m, 0.0).when(m.known())
    return yearly(total.when(night.known()).sqrt(), annualize, trading_periods)


# regression


@operator("CorrelationStat", "stat/correlation", "{source_col}_{target_col}_corr_{period}", requires=("{source_col}", "{target_col}"), source_col="close", target_col="volume", period=30)
def _(b, source_col, target_col, period):
    """Correlation of two columns; 0 where there is none."""
    x, y = b.col(source_col), b.col(target_col)
    return x.agg("corr", period, 0, y).or_else(0.0).when(x.sum(period).known() & y.sum(period).known())


@operator("BetaStat", "stat/beta", "{source_col}_beta_{period}", requires=("{source_col}", "{benchmark_col}"), source_col="close", benchmark_col="benchmark", period=30)
def _(b, source_col, benchmark_col, period):
    """Slope of the returns on the benchmark's returns."""
    x, y = b.col(source_col), b.col(benchmark_col)
    rx, ry = (x / x.lag() - 1).column(), (y / y.lag() - 1).column()
    both = rx.known() & ry.known()
    rx, ry = rx.when(both).column(), ry.when(both).column()
    v = ry.var(period, 3)
    return rx.agg("regr_slope", period, 3, ry).when((v > 1e-10) & (b.i >= period - 1))


def regression(cls, name, tag):
    return stat(cls, name, tag, period=30)


def fitted(b, x, period, row):
    """The window's least-squares line at a place in the window."""
    return x.fir(line_matrix(period)[row])


@regression("RSquaredStat", "rsquared", "r2")
def _(b, source_col, period):
    """Share of the variance that a line explains."""
    x = b.col(source_col)
    i = b.i
    r = x._mix(x.sql, i).agg("corr", period, period, (i * 1.0).column())
    return (r * r).when(x.agg("var_pop", period) * period > 1e-10)


@regression("LinRegSlopeStat", "linreg_slope", "slope")
def _(b, source_col, period):
    """Slope of the line."""
    t = np.arange(period) - (period - 1) / 2
    return b.col(source_col).fir(t / (t @ t))


@regression("LinRegInterceptStat", "linreg_intercept", "intercept")
def _(b, source_col, period):
    """The line at the start of the window."""
    return fitted(b, b.col(source_col), period, 0)


@regression("LinRegResidualStat", "linreg_residual", "residual")
def _(b, source_col, period):
    """The last value less the line."""
    x = b.col(source_col)
    return x - fitted(b, x, period, -1)


# returns


@operator("LogReturn", "perf/log_ret", "logret_{period}_{source}", requires=("{source}",), check=lambda period, **_: need(period >= 1, "period must be at least 1"), source="close", period=1)
def _(b, source, period):
    """Log return over ``period`` bars."""
    x = b.col(source)
    return x.ln() - x.lag(period).ln()


@operator("PctReturn", "perf/pct_ret", "pct_ret_{period}_{source}", requires=("{source}",), check=lambda period, **_: need(period >= 1, "period must be at least 1"), source="close", period=1)
def _(b, source, period):
    """Relative return over ``period`` bars."""
    x = b.col(source)
    return x / x.lag(period) - 1
