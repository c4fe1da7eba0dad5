"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint is looked up in 2^(radius + 1) - 1 tables. Bit i carries a
vector m(i) of radius + 1 bits; table v keeps the bits with an odd product of
m(i) and v. Any ``radius`` vectors leave a v orthogonal to them all, so two
fingerprints within the radius agree on all that some table keeps: no pair is
missed (Pagh's covering masks).
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

BITS = 64
#: A bucket with more fingerprints than this goes the exact way of shared neighbours instead of pairs.
PAIRED = 24
#: Shingles of a text that are counted at a time.
PART = 1 << 14


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    w, h = words(text), xxhash.xxh64_intdigest
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(islice(w, k, None) for k in range(width)))) if len(w) >= width else iter([b" ".join(w)])
    votes, n = np.zeros(BITS, dtype=np.int64), max(len(w) - width + 1, 1)
    for at in range(0, n, PART):  # besides its words, a text of any length takes bounded memory
        size = min(PART, n - at)
        part = np.fromiter((h(s, 42) for s in islice(shingles, size)), dtype="<u8", count=size)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(parts):
    for pdf in parts:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t) for t in pdf["text"]], dtype=np.int64)})


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp (long) of each row, repeated rows included."""
    common.small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInPandas(_fingerprints, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The signed 64-bit masks of the covering tables."""
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % (2 ** (radius + 1) - 1) + 1)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        bits = np.array([bin(int(m) & v).count("1") % 2 for m in vectors], dtype=np.uint8)
        masks.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return masks


def links(spark: SparkSession, reps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between ids whose fingerprints are near enough to connect all that lies within ``radius``.

    ``reps`` has one row (fp, id) per different fingerprint. Buckets of up to
    ``PAIRED`` fingerprints are compared pair by pair. Members of larger ones
    are linked through shared neighbours: two fingerprints lie within 2 bits
    exactly if some value lies within 1 bit of both, and at most 65 fingerprints
    share such a value, so nothing grows with the square of a group. For other
    radii all buckets are paired.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))])).alias("x")
    entries = reps.select("fp", "id", tables).select("fp", "id", "x.t", "x.key")
    sizes = entries.groupBy("t", "key").count().where("count > 1")
    sizes = common.settle(spark, sizes, "simhash-buckets")
    found = common.settle(spark, entries.join(sizes, ["t", "key"]), "simhash-entries")
    few = found.where(F.col("count") <= PAIRED) if radius == 2 else found
    grouped = few.groupBy("t", "key").agg(F.collect_list(F.struct("fp", "id")).alias("m"))
    a = grouped.select("m", F.posexplode("m").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))).alias("b"))
    near = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    out = near.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    if radius == 2:
        hot = found.where(F.col("count") > PAIRED).select("fp", "id").distinct()
        around = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("z")
        shared = hot.select("id", around).groupBy("z").agg(F.min("id").alias("a"), F.collect_list("id").alias("m")).where(F.size("m") > 1)
        out = out.unionByName(shared.select("a", F.explode("m").alias("b")).where("a <> b"))
    out = common.settle(spark, out.distinct(), "simhash-links")
    common.discard(spark, sizes, found)
    return out


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each end of an edge reaches.

    Hooking and pointer jumping: each round every id takes the smallest parent
    among its neighbours', hands it to its own parent, and jumps to its parent's
    parent. Rounds are written to the shared folder, so a lost executor costs
    one round at most.
    """
    both = common.settle(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    parent = common.settle(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("p")), "cc-0")
    for k in range(1, most_rounds + 1):
        seen = both.join(parent.select(F.col("id").alias("b"), F.col("p").alias("q")), "b").groupBy(F.col("a").alias("id")).agg(F.min("q").alias("m"))
        own = parent.join(seen, "id", "left").select("id", "p", F.least("p", "m").alias("m"))
        own = common.settle(spark, own, f"cc-{k}-own")
        hooks = own.groupBy(F.col("p").alias("id")).agg(F.min("m").alias("h"))
        best = common.settle(spark, own.join(hooks, "id", "left").select("id", "p", F.least("m", "h").alias("n")), f"cc-{k}-best")
        jumped = best.join(best.select(F.col("id").alias("n"), F.col("n").alias("up")), "n", "left").select("id", F.least("n", "up").alias("p"), (F.least("n", "up") != F.col("p")).alias("moved"))
        after = common.settle(spark, jumped, f"cc-{k}")
        moving = after.where("moved").limit(1).count()
        common.discard(spark, parent, own, best)
        parent = after
        if not moving:
            common.discard(spark, both)
            roots = parent.select("id", F.col("p").alias("root"))
            roots._tidemark_path = parent._tidemark_path
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(spark: SparkSession, documents: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Rows without a doc_id are fingerprinted but reach nothing: component null
    unless a row of the same fingerprint has an id. Repeated rows stay.
    """
    prints = common.settle(spark, fingerprints(documents), "simhash-prints")
    reps = common.settle(spark, prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-reps")
    edges = links(spark, reps, radius)
    roots = components(spark, edges)
    known = common.settle(spark, reps.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id")), "simhash-components")
    made = common.settle(spark, prints.join(known, "fp", "left").select("doc_id", "fp", "component_id"), "simhash")
    common.discard(spark, prints, reps, edges, roots, known)
    return made


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, the one with the smallest doc_id.

    Rows are told apart by a key of their own, so of repeated rows one stays,
    and rows without an id are linked like any other and stay only where their
    group has no id.
    """
    rows, key = common.numbered(spark, docs, "simhash-rows")
    prints = rows.select(F.col(key).alias("doc_id"), "text")
    found = near_duplicates(spark, prints).select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row"))
    keep = rows.select(F.col(key).alias("key"), "doc_id").join(found, F.col("key") == F.col("row")).groupBy("component_id").agg(F.min(first).alias("x")).select(F.col("x.row").alias("kept"))
    return common.columns(rows.join(keep, rows[key] == keep["kept"], "left_semi"), docs.columns)
