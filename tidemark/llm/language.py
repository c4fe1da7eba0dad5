"""Language identification by compression.

Each language's dictionary is a raw sample of its texts. A text is cut into
short pieces; each piece is compressed with every dictionary, and the language
whose dictionary leaves the fewest bytes over the whole text wins. Narrow
margins are reported as rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Characters of a piece; long texts would otherwise soon be their own dictionary.
PIECE = 1600
UNKNOWN = "und"
#: Bytes of all dictionaries; where there are so many languages that full ones don't fit, each gets its share.
MODEL_BYTES = 32 << 20


@dataclass
class Model:
    """Dictionaries of ``MODEL_BYTES`` together at most."""

    dictionaries: dict[str, bytes]
    level: int = 6  # lower levels search the dictionary too coarsely to tell languages apart


def fit(documents: DataFrame, dictionary_bytes: int = 96 << 10, slice_chars: int = 400, most: float = 1.5) -> Model:
    """Dictionaries of the languages of ``documents`` (text, lang).

    Only rows with a language and a text take part. A dictionary holds slices,
    from anywhere in a text, of at most ``slice_chars`` characters of about
    ``most`` times as many different texts as fit, by the hash of the text. Copies
    of a text count once throughout, so no single document or group of copies fills
    a dictionary or crowds a language's other texts out.
    """
    spark = documents.sparkSession
    known = documents.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    start = F.pmod("h", F.greatest(F.length("text") - F.lit(slice_chars), F.lit(0)) + 1).cast("int") + 1
    known = known.select("lang", F.lower(F.substr("text", start, F.lit(slice_chars))).alias("t"), "h")
    sizes = known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not sizes:
        return Model({})
    dictionary_bytes = max(1, min(dictionary_bytes, MODEL_BYTES // len(sizes)))
    wanted = most * dictionary_bytes / (slice_chars // 2)
    # a language of few texts always keeps some: shares are at least what makes eight texts likely
    share = spark.createDataFrame([(r["lang"], min(1.0, max(wanted, 8.0) / r["n"])) for r in sizes], "lang string, share double")
    unit = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / float(1 << 20)
    rows = known.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("lang", "t", "h").distinct().orderBy("lang", "h", "t").collect()
    parts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in rows:
        b = (r["t"] + "\n").encode("utf-8", "replace")
        if not held.get(r["lang"]):
            b = b[:dictionary_bytes]
        if held.get(r["lang"], 0) + len(b) <= dictionary_bytes:
            parts.setdefault(r["lang"], []).append(b)
            held[r["lang"]] = held.get(r["lang"], 0) + len(b)
    return Model({k: b"".join(v) for k, v in parts.items()})


class _Identify:
    def __init__(self, model: Model, least_margin: float):
        self.model, self.least = model, least_margin

    def __call__(self, parts):
        names = sorted(self.model.dictionaries)
        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(self.model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.model.level)
            coders.append(zstandard.ZstdCompressor(level=self.model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for pdf in parts:
            rows = [self.one(text, names, coders) for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [r[k] for r in rows] for k, c in enumerate(("lang_pred", "score", "margin", "rejected"))}})

    def one(self, text: str | None, names: list[str], coders: list) -> tuple[str, float, float, bool]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = np.zeros(len(names))
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE].lower().encode("utf-8", "replace")
            sizes += [len(c(piece)) for c in coders]
        order = np.argsort(sizes, kind="stable")
        tied = [k for k in order if sizes[k] == sizes[order[0]]]
        if len(tied) > 1:  # too short to compress: whose dictionary has more of the words
            words = {w.encode("utf-8", "replace") for w in text.lower().split()}
            order[: len(tied)] = sorted(tied, key=lambda k: -sum(w in self.model.dictionaries[names[k]] for w in words))
        first = sizes[order[0]]
        second = sizes[order[1]] if len(names) > 1 else first
        margin = float((second - first) / max(second, 1.0))
        score = 1 / (1 + math.exp(-min(float(second - first), 40.0) / 2))
        return names[order[0]], score, margin, margin < self.least


def identify(documents: DataFrame, model: Model, least_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected of every row.

    A text that is null or has no letter, and any text where no language was
    learned, is ``und`` with score 0. Ties go to the
    language whose dictionary holds more of the text's words, then to the first by name.
    ``rejected`` marks margins below ``least_margin``; lang_pred still names the
    best language. Repeated rows stay, other columns are left out.
    """
    common.small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInPandas(_Identify(model, least_margin), "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    fold = common.remainder("doc_id", 4)
    model = fit(documents.where(fold != 2).select("text", "lang"))
    return identify(documents, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
