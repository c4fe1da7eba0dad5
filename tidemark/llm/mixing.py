"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's quota of whole documents is fixed first. Its documents, in a
permuted order, form blocks; the numbers of blocks that each output shard gets
of each source come from a tree that splits the exact quotas in two again and
again (each split a multivariate hypergeometric draw from a seed of its own, so
any task can walk to any shard alone). A shard draws its disjoint run of every
source's permuted blocks and shuffles locally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of up to so many words fill up what longer ones leave of a quota.
CLASSES = (64, 512, 4096)
#: Documents that a block holds about at most, however short they are.
BLOCK_DOCS = 50_000
#: Sources are the mixture's components, each with a weight of its own; more than this is refused.
MAX_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights=(1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Target words of each source: shares by weight of all words, none above ``most`` times its size.

    Sources stand by code point, null last, with ``weights`` repeating; what a
    capped source leaves is shared again by weight.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    total = float(sum(n for _, n in order))
    w = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    out: dict[str | None, float] = {}
    free = [s for s, _ in order]
    left = total
    while free:
        unit = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / unit > cap[s]]
        if not over:
            out.update({s: left * w[s] / unit for s in free})
            break
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        free = [s for s in free if s not in set(over)]
    return out


@dataclass
class Plan:
    """What a mix takes: one row per document row (``row`` is its key, as ids may be null or repeated), with the copies taken."""

    rows: DataFrame
    seed: int


def _order(seed: int) -> list[Column]:
    """The permuted order: the hash of the id, then the id."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]


def plan(spark: SparkSession, documents: DataFrame, weights=(1, 2, 3), most: float = 3.0, seed: int = 20, block_words: int = 200_000) -> Plan:
    """How many times each document row is taken.

    Every source takes all of its documents as often as its target holds whole
    copies; the rest of the target comes from a permuted order, longest size
    class first, and shorter classes make good what longer ones left or
    overshot. A document is taken when its middle lies within its class's
    quota. A null text has size 0; a null source is a source; repeated rows are
    documents of their own; empty tables give empty mixes. A column ``_row`` is
    taken as the key of the rows; without it they are numbered here.
    """
    row = F.col(common.ROW) if common.ROW in documents.columns else F.monotonically_increasing_id()
    sized = documents.select(row.alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("class", sum((F.col("size") > c).cast("int") for c in CLASSES))
    # blocks: runs of the permuted order, in buckets of the hash whose number follows the data
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = common.settle(spark, sized.withColumn("h", key), "mix-sized")
    totals = sized.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES * 4 + 1).collect()
    by_source: dict[str | None, dict[int, tuple[int, int]]] = {}
    for r in totals:
        by_source.setdefault(r["source"], {})[r["class"]] = (r["words"], r["docs"])
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {s: sum(w for w, _ in c.values()) for s, c in by_source.items()}
    goal = targets(list(sizes.items()), weights, most)
    meta = []
    for s, classes in by_source.items():
        e = goal[s] / sizes[s] if sizes[s] else 0.0
        base = int(min(e, most))
        for c, (words, docs) in classes.items():
            buckets = int(max(1, min(max(words // block_words, docs // BLOCK_DOCS) + 1, docs)))
            meta.append((s, c, sizes[s], float(goal[s]), base, float(e - base), int(words), buckets))
    schema = "source string, class int, source_size long, target double, base int, share double, words long, buckets int"
    known = spark.createDataFrame(meta, schema)
    rows = sized.join(F.broadcast(known), F.expr("true") & sized["source"].eqNullSafe(known["source"]) & (sized["class"] == known["class"])).drop(known["source"]).drop(known["class"])
    bucket = F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.col("buckets")).cast("int")
    rows = rows.withColumn("bucket", F.least(F.greatest(bucket, F.lit(0)), F.col("buckets") - 1))
    # where each bucket starts in its class's permuted order
    starts = rows.groupBy("source", "class", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = common.settle(spark, starts.select("source", "class", "bucket", F.coalesce(before, F.lit(0)).alias("start")), "mix-starts")
    within = F.sum("size").over(Window.partitionBy("source", "class", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", F.coalesce(within, F.lit(0)))
    s2 = starts.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), "start")
    rows = rows.join(s2, rows["source"].eqNullSafe(s2["s"]) & (rows["class"] == s2["c"]) & (rows["bucket"] == s2["b"])).drop("s", "c", "b")
    rows = ordered = common.settle(spark, rows.withColumn("middle", F.col("start") + F.col("inner") + F.col("size") / 2), "mix-order")
    # quotas, longest class first; each class's is fixed by what the longer ones took
    carry = {s: 0.0 for s in by_source}
    quota: dict[tuple[str | None, int], float] = {}
    for c in sorted({c for x in by_source.values() for c in x}, reverse=True):
        part = []
        for s, classes in by_source.items():
            if c in classes:
                e = goal[s] / sizes[s] if sizes[s] else 0.0
                quota[s, c] = min(max((e - int(min(e, most))) * classes[c][0] + carry[s], 0.0), float(classes[c][0]))
                part.append((s, quota[s, c]))
        q = spark.createDataFrame(part, "qs string, quota double")
        took = rows.where(F.col("class") == c).join(F.broadcast(q), F.col("source").eqNullSafe(F.col("qs"))).where(F.col("middle") <= F.col("quota")).groupBy("source").agg(F.sum("size").alias("took")).collect()
        took = {r["source"]: r["took"] for r in took}
        for s, _ in part:
            e = goal[s] / sizes[s] if sizes[s] else 0.0
            carry[s] += (e - int(min(e, most))) * by_source[s][c][0] - took.get(s, 0)
    q = spark.createDataFrame([(s, c, v) for (s, c), v in quota.items()], "qs string, qc int, quota double")
    rows = rows.join(F.broadcast(q), rows["source"].eqNullSafe(q["qs"]) & (rows["class"] == q["qc"])).drop("qs", "qc")
    extra = (F.col("share") > 0) & (F.col("middle") <= F.col("quota")) & (F.col("size") > 0)
    rows = rows.withColumn("copies", F.least(F.col("base") + extra.cast("int"), F.lit(int(most))))
    made = common.settle(spark, rows.select("row", "doc_id", "source", "size", "source_size", "target", "copies", "class", "bucket", "h"), "mix-plan")
    common.discard(spark, sized, starts, ordered)
    return Plan(made, seed)


class _Tree:
    """Walks the splitting tree to each shard: where its run of every source's permuted blocks begins and ends."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = quotas, shards, seed

    def walk(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = 0, self.shards
        first, counts = np.zeros(len(self.quotas), dtype=np.int64), np.array(self.quotas, dtype=np.int64)
        while hi - lo > 1:
            mid, total = (lo + hi) // 2, int(counts.sum())
            share = total * (mid - lo) // (hi - lo)
            rng = np.random.default_rng([self.seed, lo, hi])
            left = rng.multivariate_hypergeometric(counts, share, method="marginals") if total else counts
            if shard < mid:
                hi, counts = mid, left
            else:
                lo, first, counts = mid, first + left, counts - left
        return first, counts

    def __call__(self, parts):
        for pdf in parts:
            out = []
            for shard in pdf["id"]:
                first, counts = self.walk(int(shard))
                out += [(int(shard), k, int(a), int(n)) for k, (a, n) in enumerate(zip(first, counts)) if n]
            yield pd.DataFrame(out, columns=["shard", "k", "first", "n"])


def mix(spark: SparkSession, made: Plan, shard_words: int = 50_000_000) -> DataFrame:
    """row, doc_id, source, size, copy, shard and place of every taken copy; ``place`` orders a shard."""
    blocks = made.rows.where("copies > 0").select("source", "class", "bucket", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "size").groupBy("source", "class", "bucket", "copy").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(made.seed + 1), "class", "bucket", "copy"), "class", "bucket", "copy")
    blocks = common.settle(spark, blocks.withColumn("p", F.row_number().over(order) - 1), "mix-blocks")
    counts = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).orderBy("source").collect()
    quotas = [r["n"] for r in counts]
    shards = max(1, min(sum(quotas), sum(r["words"] for r in counts) // shard_words + 1))
    names = spark.createDataFrame([(k, r["source"]) for k, r in enumerate(counts)], "k int, source string")
    runs = spark.range(shards).mapInPandas(_Tree(quotas, shards, made.seed), "shard long, k int, first long, n long")
    runs = runs.join(F.broadcast(names), "k").select("source", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("p"))
    b = blocks.join(runs.select(F.col("source").alias("rs"), F.col("p").alias("rp"), "shard"), blocks["source"].eqNullSafe(F.col("rs")) & (blocks["p"] == F.col("rp"))).drop("rs", "rp")
    b = common.settle(spark, b.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("u"), F.col("copy").alias("y"), "shard"), "mix-drawn")
    d = made.rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = d.join(b, d["source"].eqNullSafe(F.col("s")) & (d["class"] == F.col("c")) & (d["bucket"] == F.col("u")) & (d["copy"] == F.col("y")))
    drawn = out.select("row", "doc_id", "source", "size", "copy", "shard", F.xxhash64(F.lit(made.seed + 2), "shard", "doc_id", "copy").alias("place"))
    drawn = common.settle(spark, drawn, "mix-draws")
    common.discard(spark, blocks, b)
    return drawn


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``draws``: the shard and the place in it of every copy, null for rows not taken."""
    made = plan(spark, common.table(spark, sf_dir, "documents"))
    drawn = mix(spark, made)
    taken = drawn.groupBy("row").agg(F.sum("size").alias("words"), F.array_sort(F.collect_list(F.struct("copy", "shard", "place"))).alias("draws"))
    rows = made.rows.select("row", "doc_id", "size", "source_size", "target").join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "draws")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document row as many times as the mix takes it.

    Rows are told apart by a key of their own, so null and repeated ids change
    nothing. A null source is a source; null and empty texts have size 0 and
    are taken only with the whole copies of their source; an empty table gives
    an empty mix. Other columns are carried along.
    """
    rows, key = common.numbered(spark, docs, "mix-rows")
    made = plan(spark, rows.select(F.col(key).alias(common.ROW), "doc_id", "source", "text"))
    drawn = mix(spark, made)
    copies = common.settle(spark, drawn.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n")), "mix-copies")
    common.discard(spark, made.rows, drawn)
    out = rows.join(copies, rows[key] == copies["row"])
    made = out.select(*(rows[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), copies["n"])).alias(key))
    return common.columns(made, docs.columns)
