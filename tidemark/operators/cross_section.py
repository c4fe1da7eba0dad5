"""Statistics across series at the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.registry import Feature, Spec, SPECS, CLASSES, need

STATS = ("rank", "zscore", "mean", "std", "median", "min", "max", "diff")


def _check(col, stats, prefix):
    need(bool(stats), "stats must not be empty")
    need(not set(stats) - set(STATS), f"unknown stats {sorted(set(stats) - set(STATS))}")


class CrossSectionalStat(Feature):
    """Rank, z-score, mean, ... of a column among all series of a timestamp.

    One partial aggregation per timestamp and a join back, so a timestamp with
    very many series is never one task; only rank and median need the values of
    a timestamp together. Nulls take no part.
    """

    @property
    def outputs(self):
        p = self.params
        return [f"{p['prefix']}{p['col']}_cs_{s}" for s in p["stats"]]

    @property
    def requires(self):
        return [self.params["col"]]

    def columns(self, b):
        raise TypeError("a cross-section needs all series; use transform")

    def transform(self, bars: DataFrame, ts: str = "ts", **_) -> DataFrame:
        col, stats = self.params["col"], self.params["stats"]
        if col not in bars.columns:
            raise ValueError(f"the bars have no column {col}")
        x = F.col(col).cast("double")
        aggs = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "median": F.median(x)}
        wanted = {"mean", "std", "n"} | ({"min", "max", "median"} & set(stats))
        per = bars.groupBy(F.col(ts).alias("_ts")).agg(*(a.alias(f"_{k}") for k, a in aggs.items() if k in wanted))
        out = bars.join(per, F.col(ts).eqNullSafe(F.col("_ts")), "left")
        if "rank" in stats:
            # values below and at each distinct value; ties get their average rank
            values = bars.where(x.isNotNull()).groupBy(F.col(ts).alias("_rt"), x.alias("_rx")).agg(F.count(F.lit(1)).alias("_same"))
            from pyspark.sql import Window

            below = F.sum("_same").over(Window.partitionBy("_rt").orderBy("_rx").rowsBetween(Window.unboundedPreceding, -1))
            values = values.withColumn("_below", F.coalesce(below, F.lit(0)))
            out = out.join(values, F.col(ts).eqNullSafe(F.col("_rt")) & (x == F.col("_rx")), "left")
        made = {
            "mean": F.col("_mean"), "std": F.col("_std"), "diff": x - F.col("_mean"), "zscore": F.try_divide(x - F.col("_mean"), F.col("_std")),
        }
        made |= {k: F.col(f"_{k}") for k in ("min", "max", "median") if k in stats}
        if "rank" in stats:
            made["rank"] = (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_n")
        return out.select(*(F.col(f"`{c}`") for c in bars.columns), *(made[s].alias(o) for s, o in zip(stats, self.outputs)))


CrossSectionalStat.spec = Spec("CrossSectionalStat", "stat/cross_sectional", (), {"col": "close", "stats": ("rank", "zscore", "mean"), "prefix": ""}, None, None, "0", (), (), _check, CrossSectionalStat.__doc__)
SPECS["stat/cross_sectional"], CLASSES["CrossSectionalStat"] = CrossSectionalStat.spec, CrossSectionalStat
