"""Quality by co-training: a text view and a metadata view teach each other.

The text view sees shapes (classes of neighbouring characters) and words of the
whole text; the metadata view sees source, language and length. Texts become
vectors once. Over rounds each view looks through all other rows and hands
those that it is surest of, a fixed number of different ones a class, to the
other view. Both are then calibrated on labelled rows set apart, and a logistic
curve combines them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SHAPES, WORDS = 512, 512
SOURCES, LANGS, LENGTHS = 256, 64, 24
#: Bytes of a row's vector: the text view in half precision, then the three places of the metadata view, -1 for none.
WIDTH = 2 * (SHAPES + WORDS) + 3 * 2
VECTOR = "doc_id long, v binary"
#: Characters that are counted at a time, so very long texts need bounded memory.
PART = 1 << 18

_CLASS = np.zeros(128, dtype=np.int64)  # lower-case letters and all beyond ASCII: 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord(" ")] = 3
_CLASS[:32] = 4
_CLASS[[c for c in range(33, 128) if not chr(c).isalnum()]] = 5 + np.arange(33)


class Text:
    """Square roots of the shares of hashed shapes and words."""

    MEMORY = 200_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.known) >= self.MEMORY:
            self.known.clear()
        h = self.known[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        shapes, words = np.zeros(SHAPES), np.zeros(WORDS)
        text = text or ""
        for at in range(0, len(text), PART):
            part = text[at : at + PART]
            c = np.frombuffer(part.encode("utf-32-le", "replace"), dtype="<u4")
            k = np.where(c < 128, _CLASS[np.minimum(c, 127)], 0)
            if len(k) > 2:
                code = (k[:-2] * 38 + k[1:-1]) * 38 + k[2:]
                shapes += np.bincount((code * 2654435761 >> 12) % SHAPES, minlength=SHAPES)
            get = self.known.get
            ids = [b if (b := get(w)) is not None else self.bucket(w) for w in part.split()]
            if ids:
                words += np.bincount(ids, minlength=WORDS)
        return np.concatenate([np.sqrt(x / max(x.sum(), 1.0)) for x in (shapes, words)]).astype(np.float32)


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """The places that are 1 in the metadata view, -1 where nothing is known."""
    out = np.full(3, -1, dtype="<i2")
    if source is not None:
        out[0] = zlib.crc32(source.encode("utf-8", "replace")) % SOURCES
    if lang is not None:
        out[1] = SOURCES + zlib.crc32(lang.encode("utf-8", "replace")) % LANGS
    if n_chars is not None and n_chars == n_chars:
        out[2] = SOURCES + LANGS + min(int(np.log2(max(n_chars, 0) + 1)), LENGTHS - 1)
    return out


def views(vectors) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of rows' vectors."""
    raw = np.frombuffer(b"".join(vectors), dtype=np.uint8).reshape(-1, WIDTH)
    x = raw[:, : WIDTH - 6].copy().view("<f2").astype(np.float32)
    places = raw[:, WIDTH - 6 :].copy().view("<i2")
    z = np.zeros((len(raw), SOURCES + LANGS + LENGTHS), dtype=np.float32)
    row, k = np.nonzero(places >= 0)
    z[row, places[row, k]] = 1
    return x, z


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 250, rate: float = 0.05) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression (Adam on the whole sample)."""
    w = np.zeros(x.shape[1] + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        e = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y
        g = np.concatenate([x.T @ e / len(y) + ridge * w[:-1], [e.mean()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: slope and intercept of each view's calibration
    text_curve: np.ndarray
    meta_curve: np.ndarray
    both: np.ndarray

    def views(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        a = _margin(_margin(x, self.text)[:, None], self.text_curve)
        b = _margin(_margin(z, self.meta)[:, None], self.meta_curve)
        return np.stack([a, b], 1)


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, apart: np.ndarray, look: Callable, rounds: int = 3) -> Model:
    """Two views of labelled rows (``x``, ``z``, ``y``; ``apart`` calibrate).

    ``look(text, meta)`` gives, for the weights of both views, the rows of the
    pool that the text view and the metadata view are surest of: twice (x, z, y).
    """
    learn = ~apart
    tx, ty, mz, my = [x[learn]], [y[learn]], [z[learn]], [y[learn]]
    text, meta = logistic(x[learn], y[learn]), logistic(z[learn], y[learn])
    for _ in range(rounds):
        by_text, by_meta = look(text, meta)
        mz.append(by_text[1]), my.append(by_text[2])
        tx.append(by_meta[0]), ty.append(by_meta[2])
        if not len(by_text[2]) and not len(by_meta[2]):
            break
        text, meta = logistic(np.concatenate(tx), np.concatenate(ty)), logistic(np.concatenate(mz), np.concatenate(my))
    c = apart if apart.any() else learn
    model = Model(text, meta, np.zeros(2), np.zeros(2), np.zeros(3))
    model.text_curve = logistic(_margin(x[c], text)[:, None], y[c], 1e-2)
    model.meta_curve = logistic(_margin(z[c], meta)[:, None], y[c], 1e-2)
    model.both = logistic(model.views(x[c], z[c]), y[c], 1e-2)
    return model


def _vectors(parts):
    view = Text()
    for pdf in parts:
        v = [view(t).astype("<f2").tobytes() + metadata(s, g, n).tobytes() for t, s, g, n in zip(pdf["text"], pdf["source"], pdf["lang"], pdf["n_chars"])]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "v": v})


def vectors(documents: DataFrame) -> DataFrame:
    """doc_id and v of every row, repeated rows included."""
    common.small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))
    return rows.mapInPandas(_vectors, VECTOR)


class _Surest:
    """Of a task's rows the ``most`` different ones that each view is surest of, for either class."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, most: int, sure: float, taken: list[set]):
        self.weights, self.most, self.sure, self.taken = (text, meta), most, sure, taken

    def __call__(self, parts):
        best: dict[tuple[int, int], dict[bytes, float]] = {(t, y): {} for t in (0, 1) for y in (0, 1)}
        for pdf in parts:
            if not len(pdf):
                continue
            v = [bytes(b) for b in pdf["v"]]
            keys = [*map(_key, v)]
            for teacher, (w, side) in enumerate(zip(self.weights, views(v))):
                p = 1 / (1 + np.exp(-_margin(side, w)))
                for label, chance in ((1, p), (0, 1 - p)):
                    held = best[teacher, label]
                    for k in np.flatnonzero(chance >= self.sure):
                        if keys[k] not in self.taken[teacher]:
                            held[v[k]] = float(chance[k])
                    if len(held) > 4 * self.most:
                        best[teacher, label] = _first(held, self.most)
        rows = [(t, y, p, b) for (t, y), held in best.items() for b, p in _first(held, self.most).items()]
        if rows:
            yield pd.DataFrame(rows, columns=["teacher", "label", "p", "v"])


def _key(v: bytes) -> int:
    """What a vector is remembered by, so that sets of them stay small."""
    return xxhash.xxh3_64_intdigest(v)


def _first(held: dict[bytes, float], most: int) -> dict[bytes, float]:
    return dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:most])


def surest(pool: DataFrame, text: np.ndarray, meta: np.ndarray, most: int, sure: float, taken: list[set]) -> list:
    """(teacher, label, v): the ``most`` different rows of all of ``pool`` that each view is surest of, for either class.

    Tasks hand on their own best ones, then a few tasks the best of those.
    """
    made = pool.select("v").mapInPandas(_Surest(text, meta, most, sure, taken), "teacher int, label int, p double, v binary")
    some = made.groupBy("teacher", "label", F.pmod(F.xxhash64("v"), F.lit(64)).alias("part"), "v").agg(F.max("p").alias("p"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p"), "v"))
    some = some.withColumn("r", best("teacher", "label", "part")).where(F.col("r") <= most)
    return some.withColumn("r", best("teacher", "label")).where(F.col("r") <= most).select("teacher", "label", "v").orderBy("teacher", "label", "v").collect()


def fit(documents: DataFrame, labels: DataFrame, **how) -> Model:
    """:func:`fit_vectors` of the vectors of ``documents``."""
    made = common.settle(documents.sparkSession, vectors(documents), "quality-vectors")
    model = fit_vectors(made, labels, **how)
    common.discard(documents.sparkSession, made)
    return model


def fit_vectors(rows: DataFrame, labels: DataFrame, max_labelled: int = 5_000, most: int = 500, sure: float = 0.95) -> Model:
    """Fit on about ``max_labelled`` labelled ids, chosen by their hash, and on what the views pick from all other rows.

    Of an id's rows the one with the smallest vector counts. Every row is in the
    pool but copies of those learned from, rows without an id too; a round
    gives either view up to ``most`` different vectors of either class that the
    other one holds for certain to at least ``sure``. Labels other than 0 and 1
    take no part. With one class only, every text gets that class's share.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    unit = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(unit < max_labelled / max(known.count(), 1))
    got = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("v").alias("v"), F.first("y").alias("y")).withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(4)) == 0).orderBy("doc_id").toPandas()
    x, z = views([bytes(b) for b in got["v"]])
    learned = {_key(bytes(b)) for b in got["v"]}
    taken: list[set] = [set(learned), set(learned)]

    def look(text: np.ndarray, meta: np.ndarray):
        found = surest(rows, text, meta, most, sure, taken)
        out = []
        for teacher in (0, 1):
            own = [r for r in found if r["teacher"] == teacher]
            v = [bytes(r["v"]) for r in own]
            taken[teacher].update(map(_key, v))
            out.append((*views(v), np.array([float(r["label"]) for r in own])))
        return out

    return co_train(x, z, got["y"].to_numpy(dtype=float), got["apart"].to_numpy(dtype=bool), look)


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, parts):
        m = self.model
        sig = lambda a: 1 / (1 + np.exp(-a))
        for pdf in parts:
            if len(pdf):
                both = m.views(*views([bytes(b) for b in pdf["v"]]))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": sig(_margin(both, m.both)), "text_score": sig(both[:, 0]), "meta_score": sig(both[:, 1])})


def score_vectors(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_score and meta_score (each the chance of label 1) of every row's vector."""
    return rows.select("doc_id", "v").mapInPandas(_Score(model), "doc_id long, score double, text_score double, meta_score double")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """:func:`score_vectors` of every row of ``documents``.

    Null and empty texts have no shapes or words, null metadata no entry; they
    get what the rest says. Repeated rows are scored each.
    """
    return score_vectors(vectors(documents), model)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose crc32(doc_id as text) mod 5 is not 0."""
    made = common.settle(spark, vectors(common.table(spark, sf_dir, "documents")), "quality-vectors")
    labels = common.table(spark, sf_dir, "labels")
    model = fit_vectors(made, labels.where(common.remainder("doc_id", 5) != 0))
    held_out = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))
    return score_vectors(made, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
