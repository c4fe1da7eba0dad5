"""What the operators share: tables, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch to Python at most. Texts may be very long, so batches are kept short.
BATCH_ROWS = 256

#: The column by which operators tell rows apart; :func:`numbered` adds it or one like it.
ROW = "_row"

#: Names of files that are broadcast at most (some 200 bytes each).
NUMBERED_FILES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/tidemark-{label}-{uuid.uuid4().hex[:12]}"


def settle(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _scans_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of one file, so that its place there tells it apart."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") and node.metadataOutput().nonEmpty()


def numbered(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` with a key of its rows, for ids that may be null or repeated, and the key's column: one that ``df`` lacks.

    Rows of files go by their file's number and their place in it, which any
    later read finds again; anything else, and rows of more than
    ``NUMBERED_FILES`` files, are settled under running numbers.
    """
    key = free_name(df, ROW)
    if _scans_files(df):
        try:
            files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("k")).groupBy("path").agg(F.max("k").alias("k"))
            files = settle(spark, files, f"{label}-files")
        except AnalysisException:  # a format without places
            files = None
        if files is not None and files.count() <= NUMBERED_FILES:
            numbers = spark.createDataFrame([(r["path"], k) for k, r in enumerate(files.select("path").orderBy("path").collect())], "_path string, _file long")
            discard(spark, files)
            at_file, at_row = free_name(df, "_at_file"), free_name(df, "_at_row")
            placed = df.select("*", F.col("_metadata.file_path").alias(at_file), F.col("_metadata.row_index").alias(at_row))
            joined = placed.join(F.broadcast(numbers), placed[at_file] == numbers["_path"])
            return joined.select(*(placed[f"`{c}`"] for c in df.columns), (F.shiftleft(numbers["_file"], 43) + placed[at_row]).alias(key)), key
    return settle(spark, df.withColumn(key, F.monotonically_increasing_id()), label), key


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``df``, whatever characters they hold."""
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in names))


def discard(spark: SparkSession, *settled: DataFrame | str) -> None:
    """Delete settled tables that nothing reads any more."""
    for x in settled:
        path = x if isinstance(x, str) else getattr(x, "_tidemark_path", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts within bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text):
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
