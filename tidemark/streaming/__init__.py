"""Bars and recursive features of streams."""

from tidemark.streaming.bars import streaming_bars
from tidemark.streaming.features import streaming_features

__all__ = ["streaming_bars", "streaming_features"]
