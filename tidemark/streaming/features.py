"""Features of a bar stream: each series keeps the bars that its warm-up needs.

Every batch runs the features' own plan over the kept bars and the new ones, so
windowed operators come out exactly as over a table; recursive ones agree as
far as their declared warm-up says, for it is all of the past that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.registry import Feature
from tidemark.plans.engine import Pipeline


def _folder(df: DataFrame, path: str):
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def streaming_features(bars: DataFrame, features: Sequence[Feature], folder: str, sink: Callable[[DataFrame, int], None], pair: str = "pair", ts: str = "ts", late: str = "refuse") -> DataStreamWriter:
    """A writer that hands every batch's bars with their features to ``sink(rows, batch id)``; start it with a checkpoint location.

    ``folder``, which all executors share, holds the kept bars of the last two
    batches under their ids, so a batch that is run again finds what it found
    before. Bars may come in any order within a batch; one that is not after
    its series' last bar of an earlier batch is refused, or left out with
    ``late="drop"``. Features that sum over a whole series are refused.
    """
    if late not in ("refuse", "drop"):
        raise ValueError("late must be refuse or drop")
    plan = Pipeline(features, pair=pair, ts=ts)
    plan.refuse_whole_series()
    warm = max(plan.warmup, 1)

    def batch(df: DataFrame, batch_id: int) -> None:
        new = next(f"_new{'_' * k}" for k in range(len(df.columns) + 1) if f"_new{'_' * k}" not in df.columns)
        fs, before = _folder(df, f"{folder}/{batch_id - 1}")
        past = df.sparkSession.read.schema(df.schema).parquet(before.toString()) if fs.exists(before) else df.limit(0)
        last = past.groupBy(F.col(pair).alias("_p")).agg(F.max(ts).alias("_t"))
        tardy = F.col(pair).eqNullSafe(F.col("_p")) & (F.col(ts) <= F.col("_t"))
        if late == "refuse" and (rows := df.join(last, tardy, "left_semi").limit(3).collect()):
            raise ValueError(f"bars came after later ones of their series: {rows}")
        fresh = df.join(last, tardy, "left_anti")
        every = past.withColumn(new, F.lit(False)).unionByName(fresh.withColumn(new, F.lit(True)))
        sink(plan.transform(every).where(new).drop(new), batch_id)
        turn = F.row_number().over(Window.partitionBy(pair).orderBy(F.desc(ts)))
        every.withColumn("_r", turn).where(F.col("_r") <= warm).select(df.columns).write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        fs.delete(_folder(df, f"{folder}/{batch_id - 2}")[1], True)

    return bars.writeStream.foreachBatch(batch)
