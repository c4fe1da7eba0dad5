"""Toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against clean under a Dirichlet prior, shrunk to a
lower confidence bound; words not seen in training fall back to their prefixes.
A linear-time scan (Ruzzo and Tompa) finds every maximal passage of a text.

Extreme-value calibration aggregates them: in clean text, passages of score s
or more come as rare events at a rate that falls exponentially with s (Karlin
and Altschul's law, its rate and slope measured on clean rows set apart), so
the chance that n tokens hold r passages as good as the r-th best is a Poisson
tail. The least chance over all r is a text's evidence, so one strong passage
counts whatever the length, and so do many weak ones. A logistic curve fitted on
the rows set apart turns evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
SEGMENT = "array<struct<start:long,end:long,score:double>>"


@dataclass
class Model:
    """Fitted on bounded samples only: ``odds`` holds at most ``max_features`` entries."""

    odds: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.5
    #: Passages of clean text: those of ``level`` and more a token, how fast they thin out above it, and all a token.
    level: float = 0.0
    lam: float = 1.0
    rate: float = 1e-3
    rate_all: float = 1e-3
    slope: float = 1.0
    bias: float = -2.0

    def word(self, word: str) -> float:
        odds = self.odds
        best = max((odds.get(f, 0.0) for f in features(word)), default=0.0)
        return best if best > 0 else self.neutral

    def evidence(self, n: int, scores: list[float]) -> tuple[float, int]:
        """Minus the log of the chance of passages like these in ``n`` clean tokens, and how many of the best make it out."""
        best, most = 0.0, 0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            rate = self.rate * math.exp(-min(self.lam * (s - self.level), 600.0)) if s >= self.level else self.rate_all
            x = rare(max(n, 1) * rate, r) - math.log(r)  # every r is a look of its own
            if x > best:
                best, most = x, r
        return best, most


def rare(mean: float, r: int) -> float:
    """Minus the log of the chance of ``r`` or more Poisson events."""
    if mean <= 0:
        return math.inf
    if mean >= r + 8 * math.sqrt(mean) + 8:
        return 0.0
    term = total = 1.0
    k = r
    while term > 1e-12 * total:
        k += 1
        term *= mean / k
        total += term
    return max(0.0, mean - r * math.log(mean) + math.lgamma(r + 1) - math.log(total))


def features(word: str) -> Iterator[str]:
    """The word itself and its prefixes of 4 to 8 letters."""
    yield f"={word}"
    for k in PREFIXES:
        if k > len(word):
            return
        yield word[:k]


def segments(scores: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score), in linear time.

    ``scores`` lists the tokens of positive score in order; every token between
    two of them scores ``neutral`` (at most 0).
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, at = 0.0, -1
    for i, s in scores:
        before = total + neutral * (i - at - 1)
        total, at = before + s, i
        first, last, left, right = i, i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, left, right))
    return [(a, b, r - l) for a, b, l, r in stack]


class Scanner:
    """Scores texts with a model; remembers the scores of words, within bounds."""

    MEMORY = 400_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def chunk(self, raw: str) -> float:
        """The best score of the letter runs of a piece between spaces."""
        words = LETTERS.findall(raw.lower())
        value = max(map(self.model.word, words), default=self.model.neutral)
        if len(self.known) >= self.MEMORY:
            self.known.clear()
        self.known[raw] = value
        return value

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[str]]:
        chunks = text.split() if text else []
        get = self.known.get
        scores = [s if s is not None else self.chunk(c) for c, s in zip(chunks, map(get, chunks))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        return len(chunks), segments(hits, self.model.neutral) if hits else [], chunks

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], list[str]]:
        """A text's evidence, the passages that make it out (best first), and its tokens."""
        n, found, chunks = self.scan(text)
        e, r = self.model.evidence(n, [s for *_, s in found])
        return e, sorted(found, key=lambda x: (-x[2], x[0]))[:r], chunks

    def score(self, evidence: float) -> float:
        x = self.model.slope * evidence + self.model.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic curve, by Newton steps."""
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return 0.0, float(np.log(p / (1 - p)))
    scale = max(float(x.std()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], 1)
    cost = lambda w: float(np.logaddexp(0, (1 - 2 * y) * (a @ w)).sum() + ridge * w[0] ** 2 / 2)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.array([w[0], 0])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-6])
        step, size = np.linalg.solve(h, g), 1.0
        while cost(w - size * step) > cost(w) and size > 1e-6:  # a full step may overshoot where the classes part
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(w[0] / scale, 0.0)), float(w[1])


def _contexts(parts):
    """Distinct (word, word before it) of each class; copies of a text add nothing new."""
    for pdf in parts:
        seen: dict[tuple[str, str, int], None] = {}
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = LETTERS.findall((text or "").lower())
            seen.update(dict.fromkeys(zip(words, ["", *words], [int(toxic)] * len(words))))
        if seen:
            words, before, toxic = zip(*seen)
            yield pd.DataFrame({"word": words, "before": before, "toxic": np.array(toxic, dtype=np.int32)})


def _spread(parts):
    """Each word's counts go to all its features."""
    for pdf in parts:
        by: dict[str, list[int]] = {}
        for word, clean, toxic in zip(pdf["word"], pdf["clean"], pdf["toxic"]):
            for f in features(word):
                x = by.setdefault(f, [0, 0])
                x[0] += clean
                x[1] += toxic
        if not by:
            continue
        yield pd.DataFrame({"feature": list(by), "clean": [x[0] for x in by.values()], "toxic": [x[1] for x in by.values()]})


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_features: int = 50_000, z: float = 3.3, prior: float = 0.1, least: float = 0.3) -> Model:
    """Fit on at most about ``max_rows`` labelled rows, chosen by the hash of their id.

    Rows whose label or id is null take no part; of an id's rows the least text
    counts, of its labels the greatest. Log-odds come from three quarters of the
    rows, the extreme-value law and the logistic curve from the rest. With one
    class only, every text gets that class's share.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(known.count(), 1)
    share = min(1.0, max_rows / n)
    known = known.where((F.abs(F.xxhash64(F.lit("toxicity"), "doc_id")) % 1_000_000) < int(share * 1_000_000))
    rows = documents.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.withColumn("part", F.abs(F.xxhash64(F.lit("fold"), "doc_id")) % 4)
    rows = common.settle(spark, rows, "toxic-fit")
    pairs = rows.where("part > 0").select("text", "toxic").mapInPandas(_contexts, "word string, before string, toxic int").distinct()
    words = pairs.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    words = common.settle(spark, words, "toxic-words")
    sums = words.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).collect()
    counted = words.mapInPandas(_spread, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    model = Model()
    n0, n1 = (sums[0]["clean"], sums[0]["toxic"]) if sums else (0, 0)
    if n0 and n1:
        alpha = F.lit(prior) * (F.col("toxic") + F.col("clean"))  # the prior expects a feature as often in either class
        y1, y0, most = F.col("toxic") + alpha, F.col("clean") + alpha, prior * (n0 + n1)
        delta = F.log(y1 / F.lit(n1 + most)) - F.log(y0 / F.lit(n0 + most))
        bound = delta - F.lit(z) * F.sqrt(1 / y1 + 1 / y0)
        top = counted.where("toxic >= 2").withColumn("s", bound).where(F.col("s") >= least).orderBy(F.desc("s"), "feature").limit(max_features).collect()
        model.odds = {r["feature"]: float(r["s"]) for r in top}
    part = rows.where("part = 0").select("text", "toxic").mapInPandas(_Calibrate(model), "n long, scores array<double>, toxic int").toPandas()
    common.discard(spark, rows, words)
    return calibrate(model, [int(x) for x in part["n"]], [list(x) for x in part["scores"]], part["toxic"].to_numpy(dtype=float))


class _Calibrate:
    """Per document of the calibration rows: its length, its passages' scores, its class."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, parts):
        scanner = Scanner(self.model)
        for pdf in parts:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                n, found, _ = scanner.scan(text)
                out.append((n, [s for *_, s in found], int(toxic)))
            yield pd.DataFrame(out, columns=["n", "scores", "toxic"])


def calibrate(model: Model, sizes: list[int], scores: list[list[float]], toxic: np.ndarray) -> Model:
    """The law of clean passages, by their excess over the median one, and the curve.

    One observation of the excess is given beforehand: what the law expects
    where words of the usual score turn up at the rate of clean passages.
    """
    clean = np.array(sorted(s for row, y in zip(scores, toxic) if not y for s in row))
    tokens = max(sum(n for n, y in zip(sizes, toxic) if not y), 1)
    model.level = float(np.median(clean)) if len(clean) else 0.0
    above = clean[clean >= model.level]
    model.rate, model.rate_all = (len(above) + 0.5) / tokens, (len(clean) + 0.5) / tokens
    given = float(np.mean(list(model.odds.values()) or [1.0])) / max(-math.log(min(model.rate_all, 1.0)), 1.0)
    model.lam = float((len(above) + 1) / ((above - model.level).sum() + given))
    x = np.array([model.evidence(n, row)[0] for n, row in zip(sizes, scores)])
    model.slope, model.bias = logistic(x, toxic) if model.odds else (0.0, logistic(x[:0], x[:0])[1])
    return model


class _Score:
    def __init__(self, model: Model, most: float):
        self.model, self.most = model, most

    def __call__(self, parts):
        scanner = Scanner(self.model)
        for pdf in parts:
            scores, evidence, spans = [], [], []
            for text in pdf["text"]:
                e, own, chunks = scanner.judged(text)
                if e <= -math.log(self.most):
                    own = []
                if own:
                    ends, at = [], 0
                    for c in chunks:
                        at = text.index(c, at) + len(c)
                        ends.append(at)
                    own = [{"start": ends[a] - len(chunks[a]), "end": ends[b], "score": s} for a, b, s in sorted(own)]
                scores.append(scanner.score(e))
                evidence.append(e)
                spans.append(own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "evidence": evidence, "passages": spans})


def score(documents: DataFrame, model: Model, significance: float = 0.01) -> DataFrame:
    """doc_id, score, evidence and the passages (character offsets) of each row.

    Passages are those that make out the evidence, where its chance in clean
    text is below ``significance``. Null and empty texts have no passage and score as a clean text of one word.
    Repeated rows are scored each; other columns are left out.
    """
    common.small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInPandas(_Score(model, significance), f"doc_id long, score double, evidence double, passages {SEGMENT}")


def training_rows(labels: DataFrame) -> DataFrame:
    """The rows whose labels may be learned from."""
    return labels.where(common.remainder("doc_id", 5) != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = fit(documents, training_rows(common.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))
    return score(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.5 or more go, the rest stay whole.

    Every row is judged for itself, so null and repeated ids change nothing;
    null and empty texts are clean, an empty table gives an empty one, and other
    columns are carried along.
    """
    model = fit(docs, training_rows(common.table(spark, sf_dir, "labels")))
    common.small_batches(spark)
    return docs.mapInArrow(_Keep(model, [c.lower() for c in docs.columns].index("text")), docs.schema)


class _Keep:
    """Arrow batches without their toxic rows; no value is converted."""

    def __init__(self, model: Model, text: int):
        self.model, self.text = model, text

    def __call__(self, parts):
        scanner = Scanner(self.model)
        for batch in parts:
            clean = [scanner.score(scanner.judged(t)[0]) < 0.5 for t in batch.column(self.text).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
