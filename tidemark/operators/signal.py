"""Complexity, control, information and spectral operators of log returns and prices."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions import kernels as K
from tidemark.operators.overlap import line_matrix
from tidemark.operators.registry import need, operator
from tidemark.operators.statistics import stat


def of_returns(cls, name, tag, kernel, least, args=(), check=None, **defaults):
    """A kernel over windows of log returns, from row ``period`` on, where ``least`` (text of the parameters) are known."""

    def build(b, source_col, period, **params):
        scope = {"period": period, **params}
        v = b.log_return(b.col(source_col)).column()
        own = tuple(eval(a, {"__builtins__": {}}, scope) for a in args)  # noqa: S307 - texts of this module only
        return b.kernel(K.windowed, [v], name=kernel, p=period, start=period, least=int(eval(str(least), {"__builtins__": {}}, scope)), args=own)  # noqa: S307

    return lambda doc: stat(cls, name, tag, norm="z:period", check=check, **defaults)(_doc(build, doc))


def _doc(f, doc):
    f.__doc__ = doc
    return f


def _check_permutation(period, m, **_):
    need(2 <= m <= 7, "m must be 2 to 7")
    need(period >= m + 10, "period must be at least m + 10")


def _check_sample(period, m, **_):
    need(1 <= m <= 4, "m must be 1 to 4")
    need(period >= 30, "period must be at least 30")


def _check_bins(times=2):
    def check(period, bins, **_):
        need(bins >= 5, "bins must be at least 5")
        need(period >= times * bins, f"period must be at least {times} times bins")

    return check


def _check_dfa(period, min_box, **_):
    need(period >= 50, "period must be at least 50")
    need(min_box >= 3, "min_box must be at least 3")


def _check_kalman(period, process_noise, **_):
    need(period >= 30, "period must be at least 30")
    need(0 < process_noise <= 10, "process_noise must be over 0 and at most 10")


def _check_ar(period, ar_order, **_):
    need(1 <= ar_order <= 5, "ar_order must be 1 to 5")
    need(period >= ar_order + 10, "period must be at least ar_order + 10")


def _check_lyapunov(period, embed_dim, tau, **_):
    need(period >= 50, "period must be at least 50")
    need(2 <= embed_dim <= 7, "embed_dim must be 2 to 7")
    need(1 <= tau <= 10, "tau must be 1 to 10")
    need(period >= (embed_dim - 1) * tau + 20, "period is too short for the embedding")


def _check_pid(period, kp, ki, kd, **_):
    need(period >= 20, "period must be at least 20")
    need(min(kp, ki, kd) >= 0 and max(kp, ki, kd) > 0, "gains must not be negative, nor all 0")


def _check_error(period, forecast_horizon, **_):
    need(period >= 30, "period must be at least 30")
    need(1 <= forecast_horizon <= 5, "forecast_horizon must be 1 to 5")


of_returns("PermutationEntropyStat", "permutation_entropy", "perm_entropy", "permutation", "m + 5", ("m",), _check_permutation, period=100, m=3)("Entropy of the order of neighbouring returns.")
of_returns("SampleEntropyStat", "sample_entropy", "sampen", "sample_entropy", "m + 10", ("m", "r_mult"), _check_sample, period=80, m=2, r_mult=0.2)("How seldom similar stretches of returns go on alike.")
of_returns("LempelZivStat", "lempel_ziv", "lzc", "lempel_ziv", 20, (), lambda period, **_: need(period >= 20, "period must be at least 20"), period=100)("New words in the signs of the returns.")
of_returns("FisherInformationStat", "fisher_information", "fisher_info", "fisher", "bins * 2", ("bins",), _check_bins(), period=100, bins=20)("Steepness of the returns' density.")
of_returns("DfaExponentStat", "dfa", "dfa", "dfa", 50, ("min_box",), _check_dfa, period=200, min_box=4)("Scaling exponent of detrended fluctuations.")
of_returns("KalmanInnovationStat", "kalman_innovation", "kalman_innov", "kalman", 20, ("process_noise",), _check_kalman, period=100, process_noise=0.01)("Mean normalised surprise of a scalar filter.")
of_returns("ARCoefficientStat", "ar_coefficient", "ar_coeff", "autoregression", "ar_order + 10", ("ar_order",), _check_ar, period=100, ar_order=1)("First autoregressive coefficient.")
of_returns("LyapunovExponentStat", "lyapunov_exponent", "lyapunov", "lyapunov", "(embed_dim - 1) * tau + 20", ("embed_dim", "tau"), _check_lyapunov, period=200, embed_dim=3, tau=1)("How fast near paths part.")
of_returns("PIDErrorStat", "pid_error", "pid_error", "pid", 10, ("kp", "ki", "kd"), _check_pid, period=100, kp=1.0, ki=0.1, kd=0.05)("Size of a controller's answer to the returns.")
of_returns("PredictionErrorDecompositionStat", "prediction_error_decomp", "pred_err_decomp", "prediction_error", 20, (), _check_error, period=100, forecast_horizon=1)("Bias share of a line's forecast errors.")
of_returns("RenyiEntropyStat", "renyi_entropy", "renyi", "renyi", "bins * 2", ("bins", "alpha"), lambda period, bins, alpha, **_: (need(alpha >= 0, "alpha must not be negative"), _check_bins()(period, bins)), period=100, alpha=2.0, bins=20)("Entropy of order alpha of the returns.")


def _check_ami(period, lag, bins, **_):
    need(lag >= 1, "lag must be at least 1")
    need(bins >= 5, "bins must be at least 5")
    need(period >= lag + 2 * bins, "period must be at least lag + 2 bins")


of_returns("AutoMutualInfoStat", "auto_mutual_info", "ami", "mutual_information", "lag + bins * 2", ("lag", "bins"), _check_ami, period=100, lag=1, bins=15)("Information of returns about later ones.")
of_returns("RelativeInfoGainStat", "info_gain", "info_gain", "information_gain", "period // 2 * 2", ("period // 2", "bins"), _check_bins(4), period=100, bins=20)("Divergence of the window's halves.")


def _recent(cls, name, tag, symmetric, doc):
    def check(period, bins, short_period, **_):
        short = short_period or period // 4
        need(bins >= 5, "bins must be at least 5")
        need(period >= 2 * short, "period must be at least twice short_period")
        need(short >= bins, "short_period must be at least bins")

    def build(b, source_col, period, short_period, bins):
        v = b.log_return(b.col(source_col)).column()
        return b.kernel(K.windowed, [v], name="kullback", p=period, start=period, least=max(2 * bins, (short_period or period // 4)), args=(short_period or period // 4, bins, symmetric))

    stat(cls, name, tag, norm="z:period", check=check, period=200, short_period=None, bins=20)(_doc(build, doc))


_recent("KLDivergenceStat", "kl_divergence", "kl_div", False, "Divergence of recent returns from the window's.")
_recent("JSDivergenceStat", "js_divergence", "js_div", True, "Symmetric divergence of recent returns and the window's.")


# spectra of prices


def of_prices(cls, name, tag, kernel, args=(), check=None, norm="z:period", **defaults):
    def build(b, source_col, period, **params):
        own = tuple(params[a] for a in args)
        return b.kernel(K.windowed, [b.col(source_col)], name=kernel, p=period, start=period - 1, least=period, args=own)

    return lambda doc: stat(cls, name, tag, norm=norm, check=check, period=64, **defaults)(_doc(build, doc))


def _check_rolloff(rolloff_pct, **_):
    need(0 < rolloff_pct < 1, "rolloff_pct must be between 0 and 1")


def _check_cepstrum(period, min_quefrency, **_):
    need(1 <= min_quefrency < period // 2, "min_quefrency must be at least 1 and under half the period")


def _check_contrast(n_bands, alpha, **_):
    need(n_bands >= 1, "n_bands must be at least 1")
    need(0 < alpha <= 0.5, "alpha must be over 0 and at most 0.5")


def _check_mel(n_filters, n_coeffs, **_):
    need(n_filters >= 2, "n_filters must be at least 2")
    need(n_coeffs < n_filters, "n_coeffs must be under n_filters")


of_prices("SpectralCentroidStat", "spectral_centroid", "scentroid", "centroid")("Mean frequency.")
of_prices("SpectralEntropyStat", "spectral_entropy", "sentropy", "spectral_entropy", norm=1.0)("Evenness of the spectrum, 0 to 1.")
of_prices("ZeroCrossingRateStat", "zero_crossing_rate", "zcr", "zero_crossings")("Sign changes of the detrended window per bar.")
of_prices("SpectralRolloffStat", "spectral_rolloff", "srolloff", "rolloff", ("rolloff_pct",), _check_rolloff, rolloff_pct=0.85)("Frequency below which a share of the power lies.")
of_prices("SpectralFlatnessStat", "spectral_flatness", "sflat", "flatness")("Geometric against arithmetic mean of the power.")
of_prices("PowerCepstrumStat", "power_cepstrum", "cepstrum", "cepstrum", ("min_quefrency",), _check_cepstrum, min_quefrency=2)("Highest peak of the log spectrum's spectrum.")
of_prices("SpectralBandwidthStat", "spectral_bandwidth", "sbw", "bandwidth")("Spread of the frequencies.")
of_prices("SpectralSlopeStat", "spectral_slope", "sslope", "slope")("Slope of the log power.")
of_prices("SpectralKurtosisStat", "spectral_kurtosis", "skurt", "spectral_kurtosis")("Fourth moment of the frequencies.")
of_prices("SpectralContrastStat", "spectral_contrast", "scontrast", "contrast", ("n_bands", "alpha"), _check_contrast, n_bands=4, alpha=0.2)("Peaks against valleys of bands.")
of_prices("MFCCBandEnergyStat", "mfcc_band_energy", "mfccbe", "mel_energy", ("n_filters", "n_coeffs"), _check_mel, n_filters=20, n_coeffs=8)("Size of the first coefficients of a log filter bank.")


@stat("SpectralFluxStat", "spectral_flux", "sflux", norm="z:period", period=64)
def _(b, source_col, period):
    """Change of the unit power spectrum."""
    return b.kernel(K.flux, [b.col(source_col)], period=period)


# cycles: the last sample of the analytic signal is linear in the window


def analytic_weights(p):
    """Weights whose products with a window are the last analytic sample's parts, detrended."""
    rest = np.eye(p) - line_matrix(p)
    gain = np.zeros(p)
    gain[0] = 1
    gain[1 : (p + 1) // 2] = 2
    if p % 2 == 0:
        gain[p // 2] = 1
    last = np.fft.ifft(np.fft.fft(rest, axis=0) * gain[:, None], axis=0)[-1]
    return last.real, last.imag


def analytic(b, x, p):
    """Real and imaginary part; unknown where the detrended window is flat."""
    re, im = analytic_weights(p)
    a = x.array(p).column()
    t = np.arange(p) - (p - 1) / 2
    ss, along = x.agg("var_pop", p) * p, a.dot(t)
    a = a._mix(a.sql, ss)
    spread = ((ss - along * along / float(t @ t)) / p).sqrt().or_else(0.0)
    on = (spread >= 1e-10).column()
    return a._mix(a.sql, on).dot(re).when(on).column(), a._mix(a.sql, on).dot(im).when(on).column()


def amplitude(b, x, p):
    re, im = analytic(b, x, p)
    return (re * re + im * im).sqrt()


def phase(b, x, p):
    re, im = analytic(b, x, p)
    return im.f("atan2", re)


def wrapped(x):
    return (x - 2 * math.pi).when(x > math.pi, (x + 2 * math.pi).when(x < -math.pi, x))


def frequency(b, x, p):
    a = phase(b, x, p).column()
    return wrapped(a - a.lag())


@stat("InstAmplitudeStat", "inst_amplitude", "hamp", norm="z:period", period=40)
def _(b, source_col, period):
    """Size of the last analytic sample."""
    return amplitude(b, b.col(source_col), period)


@stat("InstPhaseStat", "inst_phase", "hphase", norm=math.pi, period=40)
def _(b, source_col, period):
    """Angle of the last analytic sample."""
    return phase(b, b.col(source_col), period)


@stat("InstFrequencyStat", "inst_frequency", "hfreq", norm="z:period", warmup="(period+1)*5", period=40)
def _(b, source_col, period):
    """Change of the phase."""
    return frequency(b, b.col(source_col), period)


@stat("PhaseAccelerationStat", "phase_acceleration", "phaseaccel", norm="z:period", warmup="(period+2)*5", period=40)
def _(b, source_col, period):
    """Change of the frequency."""
    v = frequency(b, b.col(source_col), period).column()
    return v - v.lag()


def two(cls, name, tag, warmup, **defaults):
    return operator(cls, f"stat/{name}", f"{{source_col}}_{tag}_{{fast_period}}_{{slow_period}}", norm="z:slow_period", warmup=warmup, fast_period=20, slow_period=50, **defaults)


@two("ConstructiveInterferenceStat", "constructive_interference", "cinterf", "(slow_period+smooth)*5", smooth=5)
def _(b, source_col, fast_period, slow_period, smooth):
    """How far a fast and a slow cycle swing together."""
    (r1, i1), (r2, i2) = analytic(b, b.col(source_col), fast_period), analytic(b, b.col(source_col), slow_period)
    raw = (r1 * r2 + i1 * i2).column()  # both sizes times the cosine of the angle between
    return raw.mean(smooth, 1).when(b.i >= slow_period + smooth - 2) if smooth > 1 else raw


@two("BeatFrequencyStat", "beat_frequency", "beatfreq", "(slow_period+1)*5")
def _(b, source_col, fast_period, slow_period):
    """Distance of a fast and a slow cycle's frequency."""
    x = b.col(source_col)
    return (frequency(b, x, fast_period) - frequency(b, x, slow_period)).abs()


@stat("StandingWaveRatioStat", "standing_wave_ratio", "swr", norm="z:period", warmup="(period+swr_window)*5", period=40, swr_window=20)
def _(b, source_col, period, swr_window):
    """Largest against smallest amplitude."""
    a = amplitude(b, b.col(source_col), period).column()
    lo = a.min(swr_window, 2)
    return (a.max(swr_window, 2) / lo).when((lo > 1e-10) & (b.i >= period + swr_window - 2))
