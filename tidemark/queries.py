"""The registered queries: every operator over hourly bars, and the engine's other parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark.plans import AutoFeatureNormalizer, Pipeline, pipes
from tidemark.sources import bars


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (fewer where they are large), so results of different engines can be compared.

    Exact halves would go either way; a relative step far below what is shown settles them.
    """

    def short(c):
        x = F.col(f"`{c}`")
        y = x * F.lit(1.000000000001)
        return (F.when(F.abs(x) >= 1e6, F.round(y, 0)).when(F.abs(x) >= 1e3, F.round(y, 3)).otherwise(F.round(y, 6)) + F.lit(0.0)).alias(c)

    return df.select(*(short(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def with_benchmark(df: DataFrame) -> DataFrame:
    """``benchmark``: the mean close of a timestamp."""
    mean = df.groupBy(F.col("ts").alias("_t")).agg(F.avg("close").alias("benchmark"))
    return df.join(mean, F.col("ts") == F.col("_t")).drop("_t")


def over(*features, chunk: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = bars.hourly(spark, sf_dir)
        if any("benchmark" in f.requires for f in features):
            table = with_benchmark(table)
        return rounded(Pipeline(features, chunk=chunk).transform(table, only=True))

    return query


def auto_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few features through the automatic normaliser."""
    made = Pipeline([ops.RocMom(), ops.AtrVol(), ops.ObvVolume()]).transform(bars.hourly(spark, sf_dir), only=True)
    return rounded(AutoFeatureNormalizer(window=64, warmup=64).fit_transform(made))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"flagship": over(ops.SmaSmooth(), ops.TrueRangeVol(), ops.RsiMom(), ops.BollingerVol())}
    found |= {name.replace("/", "_"): over(ops.indicator(name)) for name in ops.SPECS}
    found["bars"] = lambda spark, sf_dir: rounded(bars.hourly(spark, sf_dir))
    found["normalized_roc"] = over(ops.RocMom(normalized=True))
    found["normalized_sma"] = over(ops.SmaSmooth(normalized=True))
    found["auto_normalized"] = auto_normalized
    found |= {f"pipe_{name}": over(*make()) for name, make in pipes.MODULES.items()}
    return found
