"""Bars of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, pair: str, ts: str, value: str, tie: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """pair, ts, open, high, low, close, volume of each bucket, once the watermark has passed it.

    The same bars as :func:`tidemark.sources.bars.build` makes of a table, for
    events no later than ``lateness``; later ones are left out.
    """
    rows = events.where(f"{pair} is not null and {ts} is not null and {value} is not null").withColumn(ts, F.col(ts).cast("timestamp"))
    place, x = F.struct(F.col(ts), F.col(tie)), F.col(value).cast("double")
    made = (
        rows.withWatermark(ts, lateness)
        .groupBy(F.col(pair).alias("pair"), F.window(F.col(ts), width).alias("_w"))
        .agg(F.min_by(x, place).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, place).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )
    return made.select("pair", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
