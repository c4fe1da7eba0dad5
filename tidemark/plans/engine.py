"""Runs sets of operators: one exchange and sort, native stages, one kernel pass per level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import KEYS, ORDER, Builder, Kernel, X
from tidemark.operators.registry import Feature


def _series(kernels: list[Kernel], order: str, keep: list[str]):
    """A function that runs all kernels of a level over one series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = {c: pdf[c] for c in keep}
        with np.errstate(all="ignore"):
            for k in kernels:
                made = k.fn(*(pdf[c].to_numpy(dtype=float) for c in k.inputs), **k.params)
                for name, values in zip(k.outputs, made if isinstance(made, tuple) else (made,)):
                    values = np.asarray(values, dtype=float)
                    out[name] = np.where(np.isfinite(values), values, np.nan)
        return pd.DataFrame(out, index=pdf.index)

    return one


def _names(sql: str, columns: set[str]) -> set[str]:
    import re

    return set(re.findall(r"[A-Za-z_]\w*", sql)) & columns


def run(df: DataFrame, b: Builder, results: dict[str, X], keys: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of ``df`` and ``results`` by name."""
    results = {name: x.column() for name, x in results.items()}  # worked out as soon as they can be, not carried in parts
    places = lambda s: s.replace(KEYS, ", ".join(f"`{k}`" for k in keys)).replace(ORDER, f"`{order}`")
    levels = max([0, *(lv for lv, _ in b.stages), *(lv + 1 for lv in b.kernels), *(x.level for x in results.values())])
    for level in range(levels + 1):
        for depth in sorted(d for lv, d in b.stages if lv == level):
            stage = b.stages[level, depth]
            df = df.selectExpr("*", *(f"{places(sql)} AS {name}" for name, sql in stage.items()))
        if level in b.kernels:
            kernels = b.kernels[level]
            later = [s for (lv, _), stage in b.stages.items() if lv > level for s in stage.values()] + [x.sql for x in results.values()]
            later += [i for lv, ks in b.kernels.items() if lv > level for k in ks for i in k.inputs]
            have = set(df.columns)
            used = set().union(*(_names(s, have) for s in later)) if later else set()
            carried = list(dict.fromkeys([*keys, order, *keep, *sorted(used)]))
            inputs = list(dict.fromkeys([*carried, *(i for k in kernels for i in k.inputs)]))
            schema = T.StructType([df.schema[c] for c in carried] + [T.StructField(n, T.DoubleType()) for k in kernels for n in k.outputs])
            df = df.select(*(f"`{c}`" for c in inputs)).groupBy(*(f"`{k}`" for k in keys)).applyInPandas(_series(kernels, order, carried), schema)
    return df.selectExpr(*(f"`{c}`" for c in keep), *(f"{x.sql} AS `{name}`" for name, x in results.items()))


def _refuse_whole_series(b: Builder) -> None:
    if any("UNBOUNDED PRECEDING" in sql and "row_number()" not in sql for stage in b.stages.values() for sql in stage.values()):
        raise ValueError("some of these features look back over a whole series, so it can't be cut into pieces")


class Pipeline:
    """A list of features over bars of many series.

    Series are independent. A row is a bar; rows that tie on (``pair``, ``ts``)
    have no defined order. NaN in a column that a feature reads counts as null, in what
    is kept as well, and unknown results are null. With ``chunk`` each series
    is cut into pieces of that many rows, each with the ``warmup`` rows before
    it, so one long series runs as many tasks: windowed operators stay exact,
    recursions agree as far as their warm-up says.
    """

    def __init__(self, features: Sequence[Feature], pair: str = "pair", ts: str = "ts", chunk: int | None = None):
        self.features, self.pair, self.ts, self.chunk = list(features), pair, ts, chunk

    @property
    def warmup(self) -> int:
        return max((f.warmup for f in self.features), default=0)

    @property
    def outputs(self) -> list[str]:
        return [o for f in self.features for o in f.outputs]

    def refuse_whole_series(self) -> None:
        """Raise where a feature needs all of a series' past, not just a warm-up."""
        b = Builder()
        for f in self.features:
            if hasattr(f.spec, "build"):
                f.columns(b)
        _refuse_whole_series(b)

    def transform(self, bars: DataFrame, only: bool = False) -> DataFrame:
        """``bars`` (or just pair and ts, with ``only``) and all outputs; an output named twice is the later feature's."""
        from tidemark.operators.cross_section import CrossSectionalStat

        across = [f for f in self.features if isinstance(f, CrossSectionalStat)]
        own = [f for f in self.features if not isinstance(f, CrossSectionalStat)]
        if missing := sorted({r for f in own for r in f.requires} - set(bars.columns)):
            raise ValueError(f"the bars have no columns {missing}")
        read = {r for f in own for r in f.requires} | {f.params["col"] for f in across}
        bars = bars.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c, t in bars.dtypes if c in read and t in ("double", "float")})
        b, results = Builder(), {}
        for f in own:
            results |= dict(zip(f.outputs, f.columns(b)))
        keep = [self.pair, self.ts] if only else [c for c in bars.columns if c not in results]
        kept = list(dict.fromkeys([*keep, *(f.params["col"] for f in across if f.params["col"] not in results)]))
        if not results:
            out = bars
        elif self.chunk:
            out = self._chunked(bars, b, results, kept)
        else:
            out = run(bars, b, results, [self.pair], self.ts, kept)
        for f in across:
            out = f.transform(out, ts=self.ts)
        return out.select(*(f"`{c}`" for c in [*keep, *dict.fromkeys(self.outputs)]))

    def _chunked(self, bars: DataFrame, b: Builder, results: dict[str, X], keep: list[str]) -> DataFrame:
        _refuse_whole_series(b)
        day = F.date_trunc("day", F.col(self.ts).cast("timestamp_ntz"))
        counts = bars.groupBy(self.pair, day.alias("_day")).count()
        before = F.sum("count").over(Window.partitionBy(self.pair).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(F.col(self.pair).alias("_p"), F.col("_day").alias("_d"), F.coalesce(before, F.lit(0)).alias("_before"))
        rows = bars.withColumn("_day", day)
        at = F.row_number().over(Window.partitionBy(self.pair, "_day").orderBy(self.ts)) - 1
        rows = rows.withColumn("_at", at).join(counts, F.col(self.pair).eqNullSafe(F.col("_p")) & (F.col("_day") == F.col("_d"))).withColumn("_at", F.col("_at") + F.col("_before"))
        # a row serves its own piece and those whose warm-up it is part of
        last = F.floor((F.col("_at") + self.warmup) / self.chunk)
        rows = rows.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_at") / self.chunk), last)))
        rows = rows.drop("_day", "_p", "_d", "_before")
        out = run(rows, b, results, [self.pair, "_piece"], self.ts, list(dict.fromkeys([*keep, "_at", "_piece"])))
        return out.where(F.floor(F.col("_at") / self.chunk) == F.col("_piece")).drop("_at", "_piece")
