"""All operators. ``indicator("momentum/rsi", period=14)`` or ``RsiMom(period=14)``."""

from tidemark.operators import cross_section, divergence, momentum, overlap, signal, statistics, trend, volatility, volume  # noqa: F401
from tidemark.operators.registry import CLASSES, SPECS, Feature, operator

globals().update(CLASSES)
__all__ = ["SPECS", "Feature", "indicator", "operator", *CLASSES]


def indicator(name: str, *args, **params) -> Feature:
    """The operator registered under ``name``."""
    return CLASSES[SPECS[name].cls](*args, **params)
