"""Row keys, scratch tables and column names that operators share."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, mixing, simhash


def test_rows_of_files_keep_their_keys(spark, tmp_path):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, None)] * 50
    spark.createDataFrame(rows, "doc_id long, _row string").repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("doc_id is null or doc_id < 3").select("_row", "doc_id")
    first, key = common.numbered(spark, df, "t")
    assert key == "_row_" and first.columns == ["_row", "doc_id", key]
    a = {r[key]: (r._row, r.doc_id) for r in first.collect()}
    b = {r[key]: (r._row, r.doc_id) for r in common.numbered(spark, df.repartition(3).select("*"), "t")[0].collect()}
    again = {r[key]: (r._row, r.doc_id) for r in first.select("*").sort(F.desc(key)).collect()}
    assert len(a) == len(b) == 200 and a == again and sorted(map(str, a.values())) == sorted(map(str, b.values()))


def test_rows_that_are_no_rows_of_files_are_numbered(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "doc_id long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for other in (df.unionByName(df), df.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), df.crossJoin(df.withColumnRenamed("doc_id", "e"))):
        got, key = common.numbered(spark, other, "t")
        assert got.select(key).distinct().count() == 4
    got, key = common.numbered(spark, df.limit(0), "t")
    assert got.count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_near_copies_of_odd_rows(spark, tmp_path, stored):
    """Repeated rows, rows without an id, and columns whose names the stage uses itself."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (3, text, 4), (None, "other words here", 5), (None, "other words here", 6), (9, None, 7), (9, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("fp", F.col("row")).withColumn("_row", F.col("row")).withColumn("component_id", F.lit("x"))
    if stored:
        docs.write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    got = simhash.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(r.row for r in got.collect())
    assert len(kept) == 3 and kept[0] == 4 and kept[1] in (5, 6) and kept[2] in (7, 8)
    assert simhash.drop_near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_the_mix_of_odd_rows(spark, tmp_path, stored):
    """Every row is drawn for itself; nothing is lost or multiplied for want of an id."""
    rows = [(k if k % 3 else None, "w " * (k % 50), ["a", "b", None][k % 3], k) for k in range(600)] + [(1, "w " * 30, "a", 1000 + k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumn("_copies", F.lit(1)).withColumn("row", F.lit("r"))
    if stored:
        docs.write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    got = mixing.mix_stage(spark, docs, "")
    assert got.columns == docs.columns
    taken, size, source = {}, {n: len((t or "").split()) for _, t, _, n in rows}, {n: s for _, _, s, n in rows}
    for r in got.collect():
        taken[r.n] = taken.get(r.n, 0) + 1
    assert max(taken.values()) <= 3
    total = {s: sum(size[n] for n in size if source[n] == s) for s in ("a", "b", None)}
    want = mixing.targets(list(total.items()))
    for s in total:
        assert abs(sum(c * size[n] for n, c in taken.items() if source[n] == s) - want[s]) <= 50
    assert mixing.mix_stage(spark, docs.limit(0), "").count() == 0


def test_rows_of_too_many_files_are_settled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED_FILES", 2)
    spark.range(90).repartition(5).write.parquet(f"{tmp_path}/t")
    got, key = common.numbered(spark, spark.read.parquet(f"{tmp_path}/t"), "t")
    assert got._tidemark_path and got.select(key).distinct().count() == 90
