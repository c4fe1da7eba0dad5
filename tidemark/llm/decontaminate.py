"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores one posting (term, row, pos) per training word that the
test set has as well; no other word can match. Each 13-word window of an item
is looked up from its two rarest terms: their lists, shifted by the terms'
offsets, are intersected, and what is left is checked word by word against the
index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What holds at most so many bytes is broadcast; beyond it joins go by shuffle.
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(common.ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def item_terms(items: DataFrame) -> DataFrame:
    """(item, pos, term, n): the words of each item; ``item`` is the id as text."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("w"))
    words = words.where(F.size("w") > 0).distinct().select("item", F.xxhash64("w").alias("version"), F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))
    return words


class Index:
    """Postings (tid, row, pos) in the shared folder; ``lengths`` has row, doc_id and number of words of each document row.

    Documents are told apart by a key of their rows, as ids may be null or
    repeated: the column ``_row`` where there is one, else a number given here.
    Terms go by a 64-bit hash, under the first seed that keeps all of them apart.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, vocabulary: DataFrame):
        row = F.col(common.ROW) if common.ROW in documents.columns else F.monotonically_increasing_id()
        rows = documents.select(row.alias("row"), "doc_id", tokens(F.col("text")).alias("w"))
        # the last posting of each document, of the empty term, holds its length and id
        rows = rows.select("row", "doc_id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
        terms = vocabulary.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
        for self.seed in range(8):
            known = terms.select("term", self.tid("term").alias("tid"))
            size = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("apart"), F.sum(F.octet_length("term") + 64).alias("bytes")).first()
            if size["n"] == size["apart"]:
                break
        else:
            raise RuntimeError("no seed keeps the terms apart")
        last = F.col("term") == ""
        made = rows.join(_sized(known, size["bytes"]), "term").select(F.when(~last, F.col("tid")).alias("tid"), "row", "pos", F.when(last, F.col("doc_id")).alias("doc_id"))
        self.table = common.settle(spark, made, "postings")
        self.postings = self.table.where("tid is not null").select("tid", "row", "pos")
        self.lengths = self.table.where("tid is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def tid(self, term: str) -> Column:
        return F.xxhash64(F.lit(self.seed), term)


def matches(spark: SparkSession, index: Index, items: DataFrame, width: int = 13, slack: int = 0) -> DataFrame:
    """(item, version, n, row, diag, at): alignments with the item positions that agree there.

    ``diag`` is document position minus item position. Every alignment that
    holds a whole window is returned, those that hold at least the two rarest
    terms of one, and with ``slack`` those within so many words of either.
    """
    terms = common.settle(spark, items.select("item", "version", "n", "pos", index.tid("term").alias("tid")), "item-terms")
    counts = index.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weighed = common.settle(spark, terms.join(counts, "tid", "left").select("item", "version", "n", "pos", "tid", F.coalesce("df", F.lit(0)).alias("df")), "weighed")
    # windows whose terms all occur in the corpus, each with its two rarest positions
    starts = weighed.select("item", "version", "n", "pos", "tid", "df", F.explode(F.sequence(F.greatest(F.col("pos") - F.lit(width - 1), F.lit(0)), F.least(F.col("pos"), F.greatest(F.col("n") - F.lit(width), F.lit(0))))).alias("start"))
    rare = starts.groupBy("item", "version", "n", "start").agg(F.min("df").alias("least"), F.slice(F.sort_array(F.collect_list(F.struct("df", "pos", "tid"))), 1, 2).alias("r")).where("least > 0")
    windows = common.settle(spark, rare.select("item", "version", "n", "start", F.transform("r", lambda x: x["pos"]).alias("need"), "r"), "windows")
    anchors = windows.select("item", "version", "n", F.explode("r").alias("x")).select("item", "version", "n", F.col("x.pos").alias("ipos"), F.col("x.tid").alias("tid")).distinct()
    anchors = common.settle(spark, anchors, "anchors")
    held = lambda df, each: df.agg(F.sum(F.octet_length("item") + F.lit(each))).first()[0] or 0
    hits = index.postings.join(_sized(anchors, held(anchors, 64)), "tid").select("item", "version", "n", "row", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos")
    lists = hits.groupBy("item", "version", "n", "row", "diag").agg(F.collect_set("ipos").alias("have"))
    needs = windows.groupBy("item", "version").agg(F.collect_set("need").alias("needs"))
    both = lists.join(_sized(needs, held(windows, 64)), ["item", "version"]).where(F.exists("needs", lambda w: F.size(F.array_except(w, "have")) == 0))
    candidates = common.settle(spark, both.select("item", "version", "n", "row", "diag"), "candidates")
    both = candidates
    if slack:
        both = both.withColumn("diag", F.explode(F.sequence(F.col("diag") - slack, F.col("diag") + slack))).distinct()
    # every word of the candidates against the index
    spread = both.join(_sized(terms.select("item", "version", F.col("pos").alias("ipos"), "tid"), held(terms, 64)), ["item", "version"])
    spread = spread.select("item", "version", "n", "row", "diag", "ipos", "tid", (F.col("diag") + F.col("ipos")).alias("pos"))
    seen = index.postings.join(spread.hint("shuffle_hash"), ["row", "pos", "tid"])
    agree = seen.groupBy("item", "version", "n", "row", "diag").agg(F.sort_array(F.collect_set("ipos")).alias("at"))
    out = common.settle(spark, agree, "aligned")
    common.discard(spark, terms, weighed, windows, anchors, candidates)
    return out


def phrases(aligned: DataFrame, width: int = 13) -> DataFrame:
    """(item, row, first, last): the document spans that repeat a whole window of an item."""
    m = F.least(F.col("n"), F.lit(width))
    # positions are sorted and distinct: a window starts where the (m - 1)th after it is m - 1 further on
    starts = F.filter("at", lambda s, k: F.coalesce(F.get("at", k + m - 1) - s == m - 1, F.lit(False)))
    return aligned.select("item", "row", "diag", m.alias("m"), F.explode(starts).alias("s")).select("item", "row", (F.col("s") + F.col("diag")).alias("first"), (F.col("s") + F.col("diag") + F.col("m") - 1).alias("last"))


def proximity(aligned: DataFrame, share: float = 0.8, slack: int = 2) -> DataFrame:
    """(item, row, diag, share): places where at least ``share`` of an item's words stand in order but for small shifts.

    Alignments of an item in a document whose diagonals follow each other
    within ``slack`` words are one place, so inserted, removed and replaced
    words are borne; ``diag`` is its first diagonal. ``aligned`` comes from
    :func:`matches` with the same slack; a place is found from a diagonal that
    holds the two rarest terms of some window.
    """
    own = Window.partitionBy("item", "version", "row").orderBy("diag")
    opens = F.coalesce(F.col("diag") - F.lag("diag").over(own) > slack, F.lit(True)).cast("int")
    placed = aligned.withColumn("opens", opens).withColumn("place", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = placed.groupBy("item", "version", "row", "place").agg(F.min("diag").alias("diag"), F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"))
    part = F.col("held") / F.col("n")
    return merged.where(part >= share).select("item", "row", "diag", part.alias("share"))


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, width: int = 13, tolerated: int = 20) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document row.

    A null or empty text has no words; a null item id or an item without words
    takes no part. Every row is a document of its own, whether its doc_id is
    null, repeated or neither; ``row`` is its key (see :class:`Index`). One
    word in ``tolerated`` hit makes a document contaminated.
    """
    items = common.settle(spark, item_terms(benchmark), "items")
    index = Index(spark, documents, items)
    aligned = matches(spark, index, items, width)
    spans = common.settle(spark, phrases(aligned, width).distinct(), "spans")
    hit = spans.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = spans.select("row", "item").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    found = common.settle(spark, hit.join(found, "row"), "hits")
    common.discard(spark, items, aligned, spans)
    rows = index.lengths.join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    made = rows.select(
        "row",
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (tolerated * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
    made = common.settle(spark, made, "decontaminated")
    common.discard(spark, index.table, found)
    return made


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that repeat a whole window of a benchmark item go, however long they are; the rest stay whole.

    Rows stand for themselves: null and repeated ids change nothing, null and
    empty texts stay, an empty table gives an empty one, and other columns are
    carried along.
    """
    rows, key = common.numbered(spark, docs, "decontaminate-rows")
    found = decontaminate(spark, rows.select(F.col(key).alias(common.ROW), "doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    bad = found.where("n_hit > 0").select("row")
    return common.columns(rows.join(bad, rows[key] == bad["row"], "left_anti"), docs.columns)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, least(13, len(w)) AS m, list_aggregate(w[s : s + least(13, len(w)) - 1], 'string_agg', ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, s, m, list_aggregate(w[s : s + m - 1], 'string_agg', ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS s) WHERE len(w) >= m
), hits AS (SELECT DISTINCT dw.doc_id, dw.s, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
