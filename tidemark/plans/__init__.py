"""Pipelines, presets and the automatic normaliser."""

from tidemark.plans.auto_norm import AutoFeatureNormalizer
from tidemark.plans.engine import Pipeline

__all__ = ["AutoFeatureNormalizer", "Pipeline"]
