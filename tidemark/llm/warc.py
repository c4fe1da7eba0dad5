"""WARC archives: writing with deduplication, and reading by boundary-chain verification.

Archives are written by Spark's own text writer, one record per row with the
record's closing blank lines as separator, so payload bytes never pass through
Python and a lost task leaves nothing behind. Reading splits at the version
line. A payload may hold that line too, so every occurrence is only a
candidate: it names its successor (its offset plus its length), and pointer
jumping from the start of each file keeps what the chain really reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
ROUNDS = 48
#: Groups of copies, or cut pieces, up to which what is known of them is broadcast (some 50 bytes each).
BROADCAST_ROWS = 100_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Control characters can't stand in one."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, and keeper: the page_id of the record that a revisit refers to.

    Payloads are the html, null as empty. Of equal payloads of at least
    ``least_bytes`` bytes the row with the largest page_id is kept; rows with
    that same page_id and payload are all kept. Rows without a page_id are
    smallest; a group of only such rows is kept whole.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    copies = narrow.select("page_id", base32_sha1(F.col("payload")).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = common.settle(pages.sparkSession, copies, "warc-copies")
    # few groups of copies spare the payloads a shuffle; beyond the bound they are shuffled by digest
    joined = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "digest", "left")
    keeper = F.when((F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.withColumn("keeper", keeper)


def write(spark: SparkSession, planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``planned`` (see :func:`plan`) as archives under ``path``."""
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(BLANK))
    revisit = F.col("keeper").isNotNull()
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.coalesce(named(F.col("page_id")), F.lit("<urn:page:none>"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", named(F.col("keeper"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    made = planned.select(head.alias("head"), block.alias("block"))
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(BLANK))
    record = made.select(F.concat(F.col("head").cast("binary"), length.cast("binary"), F.col("block")).cast("string").alias("value"))
    record.write.option("lineSep", BLANK).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, seq, body): what follows each version line; ``seq`` orders a file's part."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("body"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every candidate record: its place, its successor, its headers and digests, without its payload."""
    p = pieces(spark, path)
    body = F.col("body").cast("binary")
    cut = F.instr("body", BLANK)
    head = F.when(cut > 0, F.substring("body", F.lit(1), cut - 1)).otherwise(F.lit(""))
    p = p.select("file", "part", "seq", head.alias("head"), body.alias("bytes"), F.octet_length("body").cast("long").alias("n"))
    head_bytes = F.octet_length("head") + len(BLANK)
    length = F.expr(r"try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\t]*([0-9]+)[ \\t]*\\r?$', 1) as bigint)")
    p = p.withColumn("head_bytes", head_bytes).withColumn("length", length)
    block = F.substr("bytes", (F.col("head_bytes") + 1).cast("int"), F.least(F.col("length"), F.lit(2**31 - 1)).cast("int"))
    p = p.withColumn("block", F.when(F.col("length").isNotNull(), block))
    h = F.col("head")
    return p.select(
        "file", "part", "seq", "n", "length", "head_bytes",
        _field(h, "WARC-Type").alias("type"),
        _field(h, "WARC-Record-ID").alias("record_id"),
        _field(h, "WARC-Refers-To").alias("refers"),
        F.regexp_replace(_field(h, "WARC-Payload-Digest"), "(?i)^sha1:", "").alias("digest"),
        *_payload(F.col("block")),
    )


def _payload(block: Column) -> list[Column]:
    """Length that the HTTP header states, and length and digest of what follows it."""
    text = block.cast("string")
    cut = F.instr(text, BLANK)
    head = F.substring(text, F.lit(1), F.greatest(cut - 1, F.lit(0)))
    stated = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]+)", 1)
    rest = F.substr(block, (F.octet_length(head) + len(BLANK) + 1).cast("int"))
    return [F.when(stated != "", stated).cast("long").alias("stated"), F.octet_length(rest).cast("long").alias("payload_bytes"), base32_sha1(rest).alias("found_digest")]


def chain(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``found`` with ``offset`` and ``real``: whether the chain from the start of its file reaches it.

    Offsets are sums of what stands before: of the file's earlier parts, then
    within the part. Each round of pointer jumping doubles the reach, so the
    rounds grow with the logarithm of a file's records.
    """
    m = len(MAGIC)
    key = ["file", "part", "seq"]
    w = Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # a part's first piece in a file has no version line before it
    sized = found.select(*key, "n", "length", "head_bytes")
    parts = sized.groupBy("file", "part").agg(F.sum(F.col("n") + m).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("file").alias("f"), F.col("part").alias("q"), before.alias("before"))
    inner = sized.withColumn("inner", F.coalesce(F.sum(F.col("n") + m).over(w), F.lit(0)))
    placed = inner.join(parts, (F.col("file") == F.col("f")) & (F.col("part") == F.col("q"))).select(*key, (F.col("before") + F.col("inner") - m).alias("offset"), "n", "length", "head_bytes")
    placed = placed.where("offset >= 0")  # what stands before the first version line is no record
    after = F.col("offset") + m + F.col("head_bytes") + F.col("length") + len(BLANK)
    placed = common.settle(spark, placed.select(*key, "offset", "n", after.alias("next")), "warc-placed")
    state = common.settle(spark, placed.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("real")), "warc-chain-0")
    known = state.where("real").count()
    for k in range(1, ROUNDS + 1):
        hop = state.select(F.col("file").alias("f"), F.col("offset").alias("o"), F.col("jump").alias("far"))
        told = state.where("real and jump is not null").select(F.col("file").alias("g"), F.col("jump").alias("t")).distinct()
        joined = state.join(hop, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("o")), "left").join(told, (F.col("file") == F.col("g")) & (F.col("offset") == F.col("t")), "left")
        new = common.settle(spark, joined.select("file", "offset", F.col("far").alias("jump"), (F.col("real") | F.col("t").isNotNull()).alias("real")), f"warc-chain-{k}")
        common.discard(spark, state)
        state, reached = new, new.where("real").count()
        if reached == known:
            break
        known = reached
    else:
        raise RuntimeError(f"the chains did not end in {ROUNDS} doublings")
    real = state.where("real").select(F.col("file").alias("f"), F.col("offset").alias("o"))
    out = placed.join(real, (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o")), "left").select(*key, "offset", "next", "n", F.col("o").isNotNull().alias("real"))
    out = common.settle(spark, out, "warc-real")
    common.discard(spark, placed, state)
    return out


def broken(real: DataFrame) -> DataFrame:
    """Records whose successor is neither a record nor the end of their file: damage to report."""
    ends = real.groupBy("file").agg(F.max(F.col("offset") + F.col("n") + len(MAGIC)).alias("size"))
    starts = real.where("real").select(F.col("file").alias("f"), F.col("offset").alias("o"))
    rows = real.where("real").join(ends, "file").join(starts, (F.col("file") == F.col("f")) & (F.col("next") == F.col("o")), "left")
    return rows.where("o is null and (next is null or next <> size)").select("file", "offset", "next")


def read(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, refers, digest, stated, payload_bytes and found_digest of every real record under ``path``.

    A record whose payload holds a version line was cut into several pieces;
    only such records are put together again.
    """
    found = common.settle(spark, candidates(spark, path), "warc-candidates")
    real = chain(spark, found)
    m = len(MAGIC)
    if bad := broken(real).limit(3).collect():
        raise ValueError(f"archives are damaged: {bad}")
    key = ["file", "part", "seq"]
    whole = found.join(real.where(F.col("real") & (F.col("next") == F.col("offset") + F.col("n") + m)).select(*key), key)
    whole = whole.select("type", "record_id", "refers", "digest", "stated", "payload_bytes", "found_digest")
    cut = real.where(F.col("real") & (F.col("next") > F.col("offset") + F.col("n") + m)).select(F.col("file").alias("f"), F.col("offset").alias("at"), "next")
    owner = F.last(F.when(F.col("real"), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    inner = real.withColumn("at", owner).join(cut.select("f", F.col("at").alias("a")), (F.col("file") == F.col("f")) & (F.col("at") == F.col("a"))).select(*key, "at", "offset")
    inner = common.settle(spark, inner, "warc-cut")
    n_cut = inner.count()
    if not n_cut:
        return whole
    files = inner.select("file").distinct()
    files = F.broadcast(files) if n_cut <= BROADCAST_ROWS else files
    place = F.row_number().over(Window.partitionBy("file", "part").orderBy("seq"))
    ranks = found.select(*key).join(files, "file", "left_semi").withColumn("place", place)
    inner = inner.join(ranks, key).select("file", "part", "place", "at", "offset")
    texts = pieces(spark, path).join(files, "file", "left_semi").withColumn("place", place)
    texts = texts.join(inner, ["file", "part", "place"])
    joined = texts.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("body").cast("binary").alias("b")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["b"].cast("string")), MAGIC).cast("binary")
    again = joined.select(body.alias("bytes"))
    text = F.col("bytes").cast("string")
    again = again.select("bytes", F.substring(text, F.lit(1), F.instr(text, BLANK) - 1).alias("head"))
    size = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]+)", 1).cast("int")
    again = again.withColumn("block", F.substr("bytes", (F.octet_length("head") + len(BLANK) + 1).cast("int"), size))
    h = F.col("head")
    again = again.select(_field(h, "WARC-Type").alias("type"), _field(h, "WARC-Record-ID").alias("record_id"), _field(h, "WARC-Refers-To").alias("refers"), F.regexp_replace(_field(h, "WARC-Payload-Digest"), "(?i)^sha1:", "").alias("digest"), *_payload(F.col("block")))
    return whole.unionByName(again)


def _page(urn: str) -> Column:
    return F.expr(rf"try_cast(regexp_extract({urn}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = common.scratch(spark, "warc")
    write(spark, plan(pages, least_bytes), path)
    rows = read(spark, path)
    is_revisit = F.col("type") == "revisit"
    return rows.select(
        _page("record_id").alias("page_id"),
        F.when(is_revisit, F.col("stated")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(is_revisit, F.col("digest")).otherwise(F.col("found_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(is_revisit, _page("refers")).alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, common.table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: translate(lpad(to_base(CAST('0x' || substr(x, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT), 32), 4, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
