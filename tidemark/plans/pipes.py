"""Presets: lists of features."""

from __future__ import annotations

from tidemark import operators as ops
from tidemark.operators import CLASSES
from tidemark.operators.registry import Feature

# The periods that presets set, where they differ from the operator's own.
PERIODS = {"AlmaSmooth": 9, "T3Smooth": 5, "McGinleySmooth": 20, "FramaSmooth": 20}


def _make(names: str, source_col: str = "close", normalized: bool = False, tuned: bool = False) -> list[Feature]:
    out = []
    for name in names.split():
        cls = CLASSES[name]
        params = {"source_col": source_col} if "source_col" in cls.spec.defaults else {}
        if tuned and name in PERIODS:
            params["period"] = PERIODS[name]
        out.append(cls(**params, normalized=normalized and cls.spec.norm is not None))
    return out


def smoothers_pipe(*, source_col="close", normalized=False):
    return _make("SmaSmooth EmaSmooth WmaSmooth RmaSmooth DemaSmooth TemaSmooth HmaSmooth TrimaSmooth SwmaSmooth SsfSmooth FftSmooth KamaSmooth AlmaSmooth JmaSmooth VidyaSmooth T3Smooth ZlmaSmooth McGinleySmooth FramaSmooth", source_col, normalized, True)


def price_transforms_pipe(*, source_col="close"):
    return _make("Hl2Price Hlc3Price Ohlc4Price WcpPrice TypicalPrice MidpointPrice MidpricePrice", source_col)


def overlap_pipe(*, source_col="close", normalized=False):
    return smoothers_pipe(source_col=source_col, normalized=normalized) + price_transforms_pipe(source_col=source_col)


def momentum_core_pipe(*, normalized=False):
    return _make("RsiMom RocMom MomMom CmoMom", normalized=normalized)


def momentum_oscillators_pipe(*, normalized=False):
    return _make("StochMom StochRsiMom WillrMom CciMom UoMom AoMom", normalized=normalized)


def momentum_macd_pipe(*, normalized=False):
    return _make("MacdMom PpoMom TsiMom TrixMom", normalized=normalized)


def momentum_kinematics_pipe(*, source_col="close", normalized=False):
    return _make("AccelerationMom JerkMom AngularMomentumMom TorqueMom", source_col, normalized)


def momentum_pipe(*, source_col="close", normalized=False):
    return momentum_core_pipe(normalized=normalized) + momentum_oscillators_pipe(normalized=normalized) + momentum_macd_pipe(normalized=normalized) + momentum_kinematics_pipe(source_col=source_col, normalized=normalized)


def volatility_range_pipe(*, normalized=False):
    return _make("TrueRangeVol AtrVol NatrVol", normalized=normalized)


def volatility_bands_pipe(*, normalized=False):
    return _make("BollingerVol KeltnerVol DonchianVol AccBandsVol", normalized=normalized)


def volatility_measures_pipe(*, normalized=False):
    return _make("MassIndexVol UlcerIndexVol RviVol GapVol", normalized=normalized)


def volatility_energy_pipe(*, normalized=False):
    return _make("KineticEnergyVol PotentialEnergyVol TotalEnergyVol EnergyFlowVol ElasticStrainVol TemperatureVol HeatCapacityVol FreeEnergyVol", normalized=normalized)


def volatility_pipe(*, normalized=False):
    return [f for make in (volatility_range_pipe, volatility_bands_pipe, volatility_measures_pipe, volatility_energy_pipe) for f in make(normalized=normalized)]


def volume_cumulative_pipe(*, normalized=False):
    return _make("ObvVolume AdVolume PvtVolume NviVolume PviVolume", normalized=normalized)


def volume_oscillators_pipe(*, normalized=False):
    return _make("MfiVolume CmfVolume EfiVolume EomVolume KvoVolume", normalized=normalized)


def volume_dynamics_pipe(*, normalized=False):
    return _make("MarketForceVolume ImpulseVolume MarketMomentumVolume MarketPowerVolume MarketCapacitanceVolume GravitationalPullVolume", normalized=normalized)


def volume_pipe(*, normalized=False):
    return volume_cumulative_pipe(normalized=normalized) + volume_oscillators_pipe(normalized=normalized) + volume_dynamics_pipe(normalized=normalized)


def trend_strength_pipe(*, normalized=False):
    return _make("AdxTrend AroonTrend VortexTrend VhfTrend ChopTrend ViscosityTrend ReynoldsTrend RotationalInertiaTrend MarketImpedanceTrend RCTimeConstantTrend SNRTrend OrderParameterTrend SusceptibilityTrend", normalized=normalized)


def trend_stops_pipe(*, normalized=False):
    return _make("PsarTrend SupertrendTrend ChandelierTrend HiloTrend CkspTrend", normalized=normalized)


def trend_detection_pipe(*, normalized=False):
    return _make("IchimokuTrend DpoTrend QstickTrend TtmTrend", normalized=normalized)


def trend_pipe(*, normalized=False):
    return trend_strength_pipe(normalized=normalized) + trend_stops_pipe(normalized=normalized) + trend_detection_pipe(normalized=normalized)


def stat_dispersion_pipe(*, source_col="close"):
    return _make("VarianceStat StdStat MadStat ZscoreStat CvStat RangeStat IqrStat AadStat RobustZscoreStat", source_col)


def stat_distribution_pipe(*, source_col="close"):
    return _make("MedianStat QuantileStat PctRankStat MinMaxStat SkewStat KurtosisStat EntropyStat JarqueBeraStat ModeDistanceStat AboveMeanRatioStat EntropyRateStat", source_col)


def stat_memory_pipe(*, source_col="close"):
    return _make("HurstStat AutocorrStat VarianceRatioStat DiffusionCoeffStat AnomalousDiffusionStat MsdRatioStat SpringConstantStat DampingRatioStat NaturalFrequencyStat PlasticStrainStat EscapeVelocityStat CorrelationLengthStat", source_col)


def stat_cycle_pipe(*, source_col="close"):
    return _make("InstAmplitudeStat InstPhaseStat InstFrequencyStat PhaseAccelerationStat ConstructiveInterferenceStat BeatFrequencyStat StandingWaveRatioStat SpectralCentroidStat SpectralEntropyStat", source_col)


def stat_regression_pipe(*, source_col="close"):
    return _make("RSquaredStat LinRegSlopeStat LinRegInterceptStat LinRegResidualStat", source_col)


def stat_realized_vol_pipe():
    return _make("RealizedVolStat ParkinsonVolStat GarmanKlassVolStat RogersSatchellVolStat YangZhangVolStat")


def stat_complexity_pipe(*, source_col="close"):
    return _make("PermutationEntropyStat SampleEntropyStat LempelZivStat FisherInformationStat DfaExponentStat", source_col)


def stat_info_theory_pipe(*, source_col="close"):
    return _make("KLDivergenceStat JSDivergenceStat RenyiEntropyStat AutoMutualInfoStat RelativeInfoGainStat", source_col)


def stat_dsp_pipe(*, source_col="close"):
    return _make("SpectralFluxStat ZeroCrossingRateStat SpectralRolloffStat SpectralFlatnessStat PowerCepstrumStat SpectralBandwidthStat SpectralSlopeStat SpectralKurtosisStat SpectralContrastStat MFCCBandEnergyStat", source_col)


def stat_pipe(*, source_col="close"):
    groups = (stat_dispersion_pipe, stat_distribution_pipe, stat_memory_pipe, stat_cycle_pipe, stat_regression_pipe, stat_complexity_pipe, stat_info_theory_pipe, stat_dsp_pipe)
    return [f for make in groups for f in make(source_col=source_col)] + stat_realized_vol_pipe()


def performance_pipe():
    return _make("LogReturn PctReturn")


def divergence_pipe():
    return [ops.CLASSES["MacdDivergence"](), ops.CLASSES["RsiDivergence"]()]


def all_ta_pipe(*, source_col="close", normalized=False):
    """Everything but the cross-section and the control operators."""
    return (
        overlap_pipe(source_col=source_col, normalized=normalized)
        + momentum_pipe(source_col=source_col, normalized=normalized)
        + volatility_pipe(normalized=normalized)
        + volume_pipe(normalized=normalized)
        + trend_pipe(normalized=normalized)
        + stat_pipe(source_col=source_col)
        + performance_pipe()
        + divergence_pipe()
    )


#: One preset per module, and all of it.
MODULES = {"overlap": overlap_pipe, "momentum": momentum_pipe, "volatility": volatility_pipe, "volume": volume_pipe, "trend": trend_pipe, "stat": stat_pipe, "performance": performance_pipe, "divergence": divergence_pipe, "all_ta": all_ta_pipe}
