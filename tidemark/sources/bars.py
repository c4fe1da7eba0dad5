"""Bars: open, high, low, close and volume per series and time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR, TS = "pair", "ts"


def build(events: DataFrame, pair: str, ts: str, value: str, tie: str, width: str = "1 hour", volume: str | None = None) -> DataFrame:
    """pair, ts (start of the bucket), open, high, low, close, volume.

    Events of a bucket go by (``ts``, ``tie``). Volume is the sum of a column,
    or the number of events. Rows without pair, time or value take no part;
    buckets without events give no bar. Every aggregate is partial, so a hot
    series shuffles one row per bucket and task.
    """
    rows = events.where(f"{pair} is not null and {ts} is not null and {value} is not null")
    place = F.struct(F.col(ts), F.col(tie))
    start = F.window(F.col(ts), width)["start"].cast("timestamp_ntz")
    x = F.col(value).cast("double")
    amount = F.sum(F.col(volume).cast("double")) if volume else F.count(F.lit(1)).cast("double")
    return rows.groupBy(F.col(pair).alias(PAIR), start.alias(TS)).agg(
        F.min_by(x, place).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, place).alias("close"), amount.alias("volume")
    )


def resample(bars: DataFrame, width: str, pair: str = PAIR, ts: str = TS) -> DataFrame:
    """Bars of wider buckets."""
    start = F.window(F.col(ts), width)["start"].cast("timestamp_ntz")
    return bars.groupBy(F.col(pair), start.alias("_start")).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("_start", ts)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ``events`` table, one series per event type."""
    return build(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id")
