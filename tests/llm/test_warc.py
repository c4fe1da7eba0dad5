import base64
import hashlib

from pyspark.sql import functions as F

from tidemark.llm import common, warc


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    best = {}
    for page_id, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            best[b] = max(best.get(b, (False, 0)), (page_id is not None, page_id or 0))
    out = []
    for page_id, html in rows:
        b = (html or "").encode()
        has, top = best.get(b, (False, 0))
        revisit = has and page_id != top
        out.append((page_id, len(b), sha(b), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def got(spark, rows, least=0):
    pages = spark.createDataFrame([(p, f"http://x/{p}\r\nEvil: 1", h, 1) for p, h in rows], "page_id long, url string, html string, digest int")
    return sorted((tuple(r) for r in warc.round_trip(spark, pages, least).collect()), key=str)


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_records_come_back(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é漢\r\n\r\n" * 3), (5, "other"), (None, "lost"), (None, "a"), (6, "long " * 300_000), (7, "a")]
    rows += [(10, "x WARC/1.1\r\n"), (11, INNER), (12, INNER * 40), (13, "WARC/1.1\r\n"), (14, "<p>" + INNER + "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"), (15, "WARC/1.1\r\n" * 50), (16, "WARC/1.1\r")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, 2) == expected(rows, 2)


def test_archives_are_read_in_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "997")
    try:
        rows = [(k, ("word " * (k % 90)) + (INNER if k % 3 == 0 else "") + str(k % 70)) for k in range(120)]
        assert got(spark, rows) == expected(rows)
    finally:
        spark.conf.set(key, before)


def test_no_pages(spark):
    assert got(spark, []) == []


def test_damage_is_reported(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    try:
        warc.read(spark, str(tmp_path / "a.warc"))
    except ValueError as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError("damage not seen")


def test_the_test_table(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    found = sorted((tuple(r) for r in warc.op7_warc(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert found == expected(rows)
    assert pages.where(F.col("html").contains(warc.MAGIC)).count() >= 0


def test_the_sql():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1, 'a'), (2, 'a'), (3, NULL), (4, ''), (5, 'é')) t(page_id, html)")
    assert sorted(con.execute(warc.OP7_SQL).fetchall(), key=str) == expected([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é")])
