"""Divergences of price and indicator."""

from __future__ import annotations

from tidemark.functions import kernels as K
from tidemark.operators.momentum import macd, rsi
from tidemark.operators.registry import operator

HLC = ("high", "low", "close")
SHARED = {"pivot_window": 5, "min_pivot_distance": 10, "pivot_method": "window", "lookback": 100, "min_divergence_magnitude": 0.02, "pivot_align_tolerance": 5, "strength_window": 14}
FLAGS = ("bullish", "bearish", "hidden_bullish", "hidden_bearish", "strength")


def _shared(p):
    return {"w": p["pivot_window"], "spacing": p["min_pivot_distance"], "method": p["pivot_method"], "lookback": p["lookback"], "least": p["min_divergence_magnitude"], "tolerance": p["pivot_align_tolerance"], "strength_window": p["strength_window"]}


def _flags(made):
    return [x.f("int") for x in made[:4]] + [made[4]]


@operator("MacdDivergence", "divergence/macd", "macd_{fast}_{slow}", "macd_signal_{signal}", "macd_hist_{fast}_{slow}", *(f"macd_div_{f}" for f in FLAGS), warmup="slow*5 + pivot_window*2 + lookback", requires=HLC, fast=12, slow=26, signal=9, **SHARED)
def _(b, fast, slow, signal, **rest):
    """Price against the MACD histogram: regular and hidden divergences and their strength."""
    line, sig, hist = macd(b, fast, slow, signal)
    made = b.kernel(K.macd_divergence, [b.c, line, sig, hist], 5, **_shared(rest))
    return [line, sig, hist, *_flags(made)]


@operator("RsiDivergence", "divergence/rsi", "rsi_{rsi_period}", *(f"rsi_div_{f}" for f in FLAGS), warmup="rsi_period*10 + pivot_window*2 + lookback", requires=HLC, rsi_period=14, rsi_overbought=70.0, rsi_oversold=30.0, **SHARED)
def _(b, rsi_period, rsi_overbought, rsi_oversold, **rest):
    """Price against relative strength: regular and hidden divergences and their strength."""
    r = rsi(b, rsi_period)
    made = b.kernel(K.rsi_divergence, [b.c, r], 5, oversold=rsi_oversold, overbought=rsi_overbought, **_shared(rest))
    return [r, *_flags(made)]
