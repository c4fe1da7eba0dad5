"""Token ids in a word-aligned binary format (Simple-8b).

A shard is one file: blocks, each closed by a line feed. All numbers are
little-endian. A block is

====== ======================================================================
bytes  meaning
====== ======================================================================
4      magic ``TM8B``
4      escape width e (0: none); ids of 2^e - 1 and more are escaped
4, 4   shard, block number in the shard
8      ids of the shard before this block
4 x 4  ids, words, escapes, documents that end here
13 x d each ending document: id (8), 1 if the id is null (1), ids of the block up to its end (4)
8 x w  words: the selector in the top 4 bits, then its ids from the low bits up
4 x x  the escaped ids, in order
4      crc32 of all bytes before
====== ======================================================================

Blocks are found by hopping from header to header; each is decoded alone, one
vector operation per selector.
"""

from __future__ import annotations

import array
import json
import os
import string
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

MAGIC = b"TM8B"
HEAD = struct.Struct("<4sIIIQIIII")
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u4")])
END_ID = 0
BLOCK_IDS = 1 << 16
#: Text bytes that one shard holds, about.
SHARD_BYTES = 32 << 20
# Fixed values of Simple-8b: ids in a word and bits of each, by selector; selectors 0 and 1 are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Escape widths that a block may choose.
ESCAPES = (8, 10, 12, 15)


#: Bytes of an id by the selector it needs: its share of a word; none for a run of zeros.
_SHARE = np.array([0, 0, *(8 / c for c in COUNTS[2:])])
_EDGES = np.array([1 << w for w in WIDTHS[1:]], dtype=np.uint64)
#: The selector that each id below 2^16 needs.
_NEEDS = (np.searchsorted(_EDGES, np.arange(1 << 16, dtype=np.uint64), side="right") + (np.arange(1 << 16) > 0)).astype(np.uint8)


def needs(v: np.ndarray) -> np.ndarray:
    """The last selector that holds most ids of each one's width: 0 for zeros, then 2 and up."""
    if not len(v) or v.max() < len(_NEEDS):
        return _NEEDS[v]
    return (np.searchsorted(_EDGES, v, side="right") + (v > 0)).astype(np.uint8)


def escape_width(need: np.ndarray) -> int:
    """The width past which ids are best escaped, 0 for none, by what each id costs about."""
    held = np.bincount(need, minlength=len(_SHARE))
    costs = {0: float(held @ _SHARE)}
    for e in ESCAPES:
        k = WIDTHS.index(e)
        over = held[k + 1 :].sum()
        if over:
            costs[e] = float(held[: k + 1] @ _SHARE[: k + 1]) + over * (_SHARE[k] + 4)
    return min(costs, key=costs.get)


def _selectors(need: np.ndarray) -> np.ndarray:
    """The selector of a word that starts at each id: the first whose every id fits.

    The greatest need in a window is that of two windows half as long, so all
    window lengths take a few passes over the ids.
    """
    n = len(need)
    best = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    size, most = 1, need
    for sel in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[sel]
        if count > n:
            break
        while 2 * size <= count:
            most, size = np.maximum(most[:-size], most[size:]), 2 * size
        whole = np.maximum(most[: n - count + 1], most[count - size : n - size + 1])
        best[: n - count + 1][whole <= sel] = sel
    return best


def pack(values: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
    """Simple-8b words of ids below 2^60, greedily as many ids per word as fit."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, dtype="<u8")
    best = _selectors(needs(v) if need is None else need)
    steps, starts, i = np.array(COUNTS, dtype=np.uint8)[best].tobytes(), bytearray(n), 0
    while i < n:
        starts[i] = 1
        i += steps[i]
    start = np.flatnonzero(np.frombuffer(starts, dtype=np.uint8))
    sel = best[start]
    words = sel.astype(np.uint64) << np.uint64(60)
    for k in np.unique(sel):
        if k > 1:
            rows = np.flatnonzero(sel == k)
            at, own = start[rows], words[rows]
            for j in range(COUNTS[k]):
                own |= v[at + j] << np.uint64(j * WIDTHS[k])
            words[rows] = own
    return words.astype("<u8")


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``words`` hold."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(np.array(COUNTS)[sel]) if len(sel) else np.zeros(0, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for k in np.unique(sel):
        if k > 1:
            rows = np.flatnonzero(sel == k)
            shift = np.arange(COUNTS[k], dtype=np.uint64) * np.uint64(WIDTHS[k])
            out[(ends[rows] - COUNTS[k])[:, None] + np.arange(COUNTS[k])] = (words[rows][:, None] >> shift) & np.uint64((1 << WIDTHS[k]) - 1)
    if len(out) < n:
        raise ValueError("too few words")
    return out[:n]


def block(ids: np.ndarray, shard: int, number: int, before: int, docs: list[tuple[int | None, int]]) -> bytes:
    """One block; ``docs`` has the id and the end of each document that ends in it."""
    v = np.asarray(ids, dtype=np.uint64)
    need = needs(v)
    width = escape_width(need)
    escaped = np.zeros(0, dtype="<u4")
    if width:
        code = np.uint64((1 << width) - 1)
        escaped = v[v >= code].astype("<u4")
        v, need = np.minimum(v, code), np.minimum(need, np.uint8(WIDTHS.index(width)))
    words = pack(v, need)
    table = np.zeros(len(docs), dtype=DOC)
    for k, (doc_id, end) in enumerate(docs):
        table[k] = (0 if doc_id is None else doc_id, doc_id is None, end)
    body = HEAD.pack(MAGIC, width, shard, number, before, len(v), len(words), len(escaped), len(docs)) + table.tobytes() + words.tobytes() + escaped.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def blocks(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(shard, block number, ids before, ids as uint32, table of ending documents) of each block of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, width, shard, number, before, n, n_words, n_escapes, n_docs = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        a = at + HEAD.size
        b = a + DOC.itemsize * n_docs
        c = b + 8 * n_words
        d = c + 4 * n_escapes
        if zlib.crc32(view[at:d]) != struct.unpack_from("<I", content, d)[0]:
            raise ValueError(f"damaged block at byte {at}")
        ids = unpack(np.frombuffer(view[b:c], dtype="<u8"), n)
        if n_escapes:
            ids[ids == (1 << width) - 1] = np.frombuffer(view[c:d], dtype="<u4")
        yield shard, number, before, ids.astype("<u4"), np.frombuffer(view[a:b], dtype=DOC)
        at = d + 5  # crc and line feed


def _bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


#: The byte-level alphabet: printable bytes stand for themselves, the others for what follows U+0100, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = np.arange(0x100)
_BYTE_LEVEL = np.where(np.isin(_BYTES, [*_PRINTED]), _BYTES, 0xFF + np.cumsum(~np.isin(_BYTES, [*_PRINTED]))).astype("<u2")


class Encoder:
    """Encodes texts piece by piece, remembering the ids of short pieces.

    A byte-level pre-tokenizer starts a new pre-token at a single space between
    two other characters and makes a line feed one of its own (two are two), so
    such pieces have the same ids alone as in their text. Pieces of ASCII and
    Latin letters fall further into runs of letters, digits or signs, each with
    the space before it, which go straight to the tokenizer's model. Texts with
    other white space, and all texts of a tokenizer whose file says anything
    else (:meth:`cuts`), are encoded whole.

    About ``PART`` characters are cut at a time, as bytes; each different piece
    among them is looked up once.
    """

    #: Pieces remembered at most: half of them recent, half from before.
    MEMORY = 500_000
    SHORT = 40
    #: Characters that are cut into pieces at a time.
    PART = 1 << 21
    #: Kinds of bytes, of which a run is one pre-token: space, line feed, letters, digits, signs.
    KINDS = np.select([_BYTES == 32, _BYTES == 10, np.isin(_BYTES, [*string.digits.encode()]), np.isin(_BYTES, [*string.ascii_letters.encode()]) | (_BYTES > 127)], [0, 1, 2, 3], 4).astype(np.uint8)
    #: Bytes whose pieces only the whole tokenizer cuts: the apostrophe, which may open a contraction, and beginnings of all but Latin letters.
    ODD = np.isin(_BYTES, [39, *range(0xC0, 0xC3), *range(0xC4, 0x100)])

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.cuts(json.loads(self.tokenizer.to_str()))
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def cuts(spec: dict) -> bool:
        """Whether a tokenizer file's pre-tokens are the ones that this class relies on."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        own = all(t["special"] and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens", ()))
        return splits and bare and own and model.get("type") == "BPE" and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))

    def direct(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def apart(self, text: str) -> bool:
        """Whether the text's pieces can be encoded alone."""
        if not self.plain or not text.replace("\n", "").isprintable() or any(x in text for x in ("  ", " \n", "\n ", "\n\n\n")) or text.endswith("\n\n"):
            return False
        return not any(x in text for x in self.special)  # they part a text before anything else does

    def odd(self, v: np.ndarray) -> np.ndarray:
        """Which bytes make their piece one for the whole tokenizer."""
        odd = self.ODD[v]
        odd[1:] |= (v[:-1] == 0xC3) & ((v[1:] == 0x97) | (v[1:] == 0xB7))  # signs among Latin letters
        return odd

    def starts(self, v: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces start among the bytes of texts that start at ``texts``."""
        kind = self.KINDS[v]
        outer = kind < 2
        outer[1:] |= kind[:-1] == 1
        outer[texts] = True
        inner = np.zeros(len(v), dtype=bool)
        inner[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        odd = np.flatnonzero(self.odd(v))
        if len(odd):
            at = np.append(np.flatnonzero(outer), len(v))
            own = np.unique(np.searchsorted(at, odd, side="right"))
            for a, b in zip(at[own - 1].tolist(), at[own].tolist()):
                inner[a:b] = False
        return np.flatnonzero(outer | inner)

    def parts(self, text: str) -> list[str]:
        """Long texts cut at single spaces."""
        if not self.plain:
            return [text]
        out, at = [], 0
        while len(text) - at > self.PART:
            k = text.find(" ", at + self.PART)
            while k > 0 and (text[k - 1].isspace() or text[k + 1 : k + 2].isspace()):
                k = text.find(" ", k + 1)
            if k < 0:
                break
            out.append(text[at:k])
            at = k
        return [*out, text[at:]]

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces; those not at hand are worked out, and remembered if they are short.

        When the recent half of the memory is full, it becomes the other half,
        and what of that wasn't met again is forgotten.
        """
        ids = [*map(self.new.get, pieces)]
        missing = [k for k, x in enumerate(ids) if x is None]
        fresh, old = [], self.old.get
        for k in missing:
            ids[k] = x = old(pieces[k])
            if x is None:
                fresh.append(k)
        for k, x in zip(fresh, self.work_out([pieces[k] for k in fresh])):
            ids[k] = x
        self.new.update((pieces[k], ids[k]) for k in missing if len(pieces[k]) <= self.SHORT)
        if len(self.new) >= self.MEMORY // 2:
            self.old, self.new = self.new, {}
        return ids

    def work_out(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of each piece: by the model from pre-tokens, by the whole tokenizer from odd ones."""
        if not pieces:
            return
        v = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)  # no piece holds a zero
        ends = np.flatnonzero(v == 0)
        odd = np.logical_or.reduceat(self.odd(v), np.append(0, ends[:-1] + 1))
        whole = [pieces[k].decode() for k in np.flatnonzero(odd)]
        whole = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        tokenize, words = self.model.tokenize, _BYTE_LEVEL[v].tobytes().decode("utf-16-le").split(chr(_BYTE_LEVEL[0]))
        for word, is_odd in zip(words, odd.tolist()):
            yield _bytes(next(whole).ids if is_odd else [t.id for t in tokenize(word)])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        About ``PART`` characters are in pieces at a time, however long a text is.
        """
        made: list[list[bytes]] = []  # of each text that isn't handed on yet, the ids of its parts
        held: list[tuple[list[bytes], str]] = []  # parts that wait, and where their ids go
        size = 0
        for text in texts:
            made.append([])
            for part in self.parts(text or ""):
                held.append((made[-1], part))
                size += len(part) + 16  # many empty texts are a part, too
                if size >= self.PART:
                    self._encode(held)
                    held, size = [], 0
            if not held:
                yield from map(b"".join, made)
                made = []
        self._encode(held)
        yield from map(b"".join, made)

    def _encode(self, held: list[tuple[list[bytes], str]]) -> None:
        cut, texts, at = [], [], [0]
        for own, part in held:
            if not self.apart(part):
                own.append(self.direct(part))
            elif part:
                cut.append(own)
                texts.append(part.encode())
                at.append(at[-1] + len(texts[-1]))
        if not cut:
            return
        joined = b"".join(texts)
        starts = self.starts(np.frombuffer(joined, dtype=np.uint8), np.array(at[:-1]))
        offsets = np.append(starts, len(joined)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        _, bounds, content = pieces.dictionary.buffers()
        bounds, content = np.frombuffer(bounds, dtype=np.int32)[: len(pieces.dictionary) + 1].tolist(), content.to_pybytes()
        found = self.look_up([content[a:b] for a, b in zip(bounds, bounds[1:])])
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        each = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(np.frombuffer(b"".join(found), dtype="<u4")))
        ids = each.take(pieces.indices).flatten().to_numpy().tobytes()
        ends = np.append(0, np.cumsum(sizes[pieces.indices.to_numpy()], dtype=np.int64))
        ends = (4 * ends[np.searchsorted(starts, at)]).tolist()
        for own, a, b in zip(cut, ends, ends[1:]):
            own.append(ids[a:b])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


#: Encoders by path: a worker keeps what it remembers from task to task.
_ENCODERS: dict[str, Encoder] = {}


class _Write:
    """Blocks of the documents of one partition, in order."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, parts):
        from pyspark import TaskContext

        encoder, shard = _ENCODERS.get(self.path) or Encoder(self.path), TaskContext.get().partitionId()
        _ENCODERS[self.path] = encoder
        held, size, number, before, docs = [], 0, 0, 0, []
        end = np.array([END_ID], dtype="<u4").tobytes()

        def close(ids: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"block": [block(ids, shard, number, before, docs)]})

        waiting: deque = deque()

        def texts():
            for pdf in parts:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    waiting.append(doc_id)
                    yield text

        for ids in encoder.encode_all(texts()):
            doc_id, ids = waiting.popleft(), np.frombuffer(ids + end, dtype="<u4")
            while size + len(ids) > BLOCK_IDS:
                held.append(ids[: BLOCK_IDS - size])
                ids = ids[BLOCK_IDS - size :]
                yield close(np.concatenate(held))
                held, size, number, before, docs = [], 0, number + 1, before + BLOCK_IDS, []
            held.append(ids)
            size += len(ids)
            docs.append((None if pd.isna(doc_id) else int(doc_id), size))
        if size:
            yield close(np.concatenate(held))


def write(spark: SparkSession, documents: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all texts to files under ``path``, in ascending doc_id order.

    Null ids come first. Rows of the same id stand by their text; a null text is
    empty. Every document ends with id 0. Files come from Spark's own writer, so
    lost tasks leave nothing behind.
    """
    common.small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).collect()[0]["n"] or 0
    keys = [F.col("doc_id"), F.xxhash64("text"), F.col("text").isNull(), F.monotonically_increasing_id()]
    rows = rows.withColumns({f"_k{k}": c for k, c in enumerate(keys[1:])})
    order = ["doc_id", "_k0", "_k1", "_k2"]
    rows = rows.repartitionByRange(int(size // SHARD_BYTES + 1), *order).sortWithinPartitions(*order).select("doc_id", F.col("text"))
    made = rows.mapInPandas(_Write(tokenizer), "block binary")
    made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _read(parts):
    for pdf in parts:
        for content in pdf["content"]:
            rows, open_ids, shard, at = [], [], 0, 0
            for shard, _, before, ids, docs in blocks(content):
                done = 0
                for doc_id, null, end in docs.tolist():
                    open_ids.append(ids[done:end])
                    n = sum(map(len, open_ids))
                    crc = 0
                    for x in open_ids:
                        crc = zlib.crc32(x.tobytes(), crc)
                    rows.append((shard, None if null else doc_id, at, n, crc))
                    at, done, open_ids = at + n, end, []
                if done < len(ids):
                    open_ids.append(ids[done:])
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["shard", "doc_id", "within", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "within", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under ``path``."""
    common.small_batches(spark)
    rows = files(spark, path).select("content").mapInPandas(_read, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    rows = common.settle(spark, rows, "token-rows")
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "token-ids")
    write(spark, docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark, common.table(spark, sf_dir, "documents"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents as ids, read back from the files."""
    return write_and_read(spark, docs)
