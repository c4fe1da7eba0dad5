import zlib

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import common, language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = language.op6_language(spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = found.where("held_out and lang is not null and text is not null").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_row_and_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog went to the house " * 9, "en"), ("der hund und die katze gingen nach hause " * 9, "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(train)
    assert sorted(model.dictionaries) == ["de", "en"]
    rows = [(1, "the cat and the house", 0), (2, "die katze und der hund", 0), (3, None, 0), (4, "", 0), (5, "123 !?", 0), (6, "the dog " * 60_000, 0), (6, "the dog", 0), (None, "und die", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language.identify(docs, model).collect()))
    assert got == [(0, "de"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]


def test_the_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    rows = docs.collect()
    learned = spark.createDataFrame([(r.text, r.lang) for r in rows if not held(r.doc_id)], "text string, lang string")
    model = language.fit(learned)
    text = {r.doc_id: r.text for r in rows}
    for r in language.op6_language(spark, sf).collect():
        sizes = {}
        for name, d in model.dictionaries.items():
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            t = text[r.doc_id] or ""
            sizes[name] = sum(len(coder.compress(t[k : k + language.PIECE].lower().encode())) for k in range(0, len(t), language.PIECE))
        assert r.held_out == held(r.doc_id)
        if any(map(str.isalpha, text[r.doc_id] or "")):
            assert sizes[r.lang_pred] == min(sizes.values())
        else:
            assert r.lang_pred == "und" and r.score == 0


def test_copies_crowd_no_language_out(spark):
    """Most rows of a language are copies of one text; the others still make its dictionary."""
    words = lambda k, letters: " ".join("".join(letters[(k * 7 + j * j + i) % len(letters)] for i in range(5)) for j in range(30))
    rows = [(words(k, "abcdef"), "one") for k in range(300)] + [(words(0, "ghijkl"), "two")] * 5000 + [(words(k, "ghijkl"), "two") for k in range(20)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), dictionary_bytes=2_000)
    assert sorted(model.dictionaries) == ["one", "two"]
    assert len({line for line in model.dictionaries["two"].split(b"\n") if line}) > 3


def test_many_languages_share_the_room(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 6_000)
    rows = [(f"word{k} other{k} third{k} " * 20, f"l{k:03d}") for k in range(300)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.dictionaries) == 300 and sum(map(len, model.dictionaries.values())) <= 6_000


def test_narrow_margins_are_rejected(spark):
    same = language.Model({"a": b"one two three", "b": b"one two three"})
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    (row,) = language.identify(docs, same).collect()
    assert row.rejected and row.lang_pred == "a" and row.score == 0.5


def test_nothing_to_learn_and_nothing_to_score(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.dictionaries == {}
    assert language.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert language.identify(one, model).select("lang_pred", "score").first() == ("und", 0.0)
    assert language.identify(one, model).where(F.col("rejected")).count() == 1
