import json
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_ids.Encoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 60) - 1)), max_size=400))
def test_words_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert token_ids.unpack(token_ids.pack(v), len(v)).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200), st.integers(0, (1 << 32) - 1)), min_size=1, max_size=600))
def test_blocks_round_trip(values):
    made = token_ids.block(np.array(values), 3, 5, 7, [(9, 1), (None, len(values))])
    ((shard, number, before, ids, docs),) = token_ids.blocks(made + b"\n")
    assert (shard, number, before, ids.tolist()) == (3, 5, 7, values)
    assert docs["end"].tolist() == [1, len(values)] and docs["null"].tolist() == [0, 1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé1 \n\t .,<|>  ​\r漢"), max_size=40))
def test_pieces_have_the_ids_of_the_text(encoder, text):
    assert encoder.encode(text) == encoder.direct(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "Word.", "a,", "don't", "x!?", "é", "<|endoftext|>", "12.", "漢字", "\n", "\n\n", "...", "end.\nNew"]), max_size=30))
def test_words_have_the_ids_of_the_text(encoder, words):
    text = " ".join(words)
    assert encoder.encode(text) == encoder.direct(text)
    text = text.replace(" \n", "\n").replace("\n ", "\n")
    assert encoder.encode(text) == encoder.direct(text)


def test_long_texts_are_cut_where_nothing_changes(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "PART", 20)
    monkeypatch.setattr(encoder, "MEMORY", 10)
    text = "Some words,  some  more. And a line\n and\n\nanother one that goes on and on and on.  " * 30 + "\t x"
    assert encoder.encode(text) == encoder.direct(text)


def test_special_strings_and_words(encoder):
    for text in ("a <|endoftext|> b", "x<|endoftext|>y\nz", "it's don't  we'll", "\n\na\n b \n", "a\u0085b c", "a\x1cb c"):
        assert encoder.encode(text) == encoder.direct(text)


def test_a_table_with_everything(spark):
    rows = [(5, "long " * 90_000, 1), (2, None, 2), (None, "no id", 3), (7, "", 4), (7, "twice", 5), (7, "twice", 6), (3, "ünï\ncode", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = token_ids.write_and_read(spark, docs).collect()
    encode = lambda t: (token_ids.Encoder(PATH).direct(t) if t else b"") + bytes(4)
    want = sorted((-1 if d is None else d, len(encode(t)) // 4, zlib.crc32(encode(t))) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids.write_and_read(spark, empty).count() == 0


def test_the_test_table(spark):
    got = {r.doc_id: r for r in token_ids.op9_token_ids(spark, "/root/testdata/sf0.001").collect()}
    encoder, at = token_ids.Encoder(PATH), 0
    for r in common.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect():
        ids = (encoder.direct(r.text) if r.text else b"") + bytes(4)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_other_tokenizer_files_are_encoded_whole(encoder):
    spec = json.loads(encoder.tokenizer.to_str())
    assert token_ids.Encoder.cuts(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"dropout": 0.1}}):
        assert not token_ids.Encoder.cuts(spec | change)
    other = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.plain
    text = "Some WORDS here.\nAnd it's more " * 20
    assert other.encode(text) == other.direct(text) and list(other.encode_all([text, None])) == [other.direct(text), b""]


def calls(work) -> int:
    """Calls, of Python's and of C's functions, that ``work`` makes."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def made_up(start: int, n: int) -> list[str]:
    return ["".join(chr(97 + int(c)) for c in str(k * 7919 + 1_000_003)) + (".", "&&", "é")[k % 3] for k in range(start, start + n)]


def test_new_words_and_full_blocks_take_few_calls():
    fresh, text = token_ids.Encoder(PATH), " ".join(made_up(0, 20_000))
    assert calls(lambda: fresh.encode(text)) < 9 * 20_000
    ids = np.frombuffer(fresh.encode(text), dtype="<u4")
    assert fresh.encode(text) == fresh.direct(text)
    assert calls(lambda: token_ids.block(ids, 0, 0, 0, [(1, len(ids))])) < len(ids) / 100


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé×÷ÿªµñ½9²0'’.&_ \nçÀ漢"), max_size=30))
def test_latin_letters_and_signs_have_the_ids_of_the_text(encoder, text):
    assert encoder.encode(text) == encoder.direct(text)


def test_many_empty_texts_do_not_wait(encoder):
    taken = 0

    def texts():
        nonlocal taken
        for taken in range(1, 400_001):
            yield None

    assert next(encoder.encode_all(texts())) == b"" and taken < 400_000


def test_the_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_ids.Encoder, "MEMORY", 1000)
    fresh, most = token_ids.Encoder(PATH), 0
    for k in range(0, 6000, 100):
        for text in (" ".join(made_up(k, 100)), " ".join(made_up(max(k - 900, 0), 100))):  # new words, and some met before
            assert fresh.encode(text) == fresh.direct(text)
            most = max(most, sum(len(x) for x in vars(fresh).values() if isinstance(x, dict)))
    assert most <= 1000 + 2 * 200
