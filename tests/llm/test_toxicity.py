import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import common, toxicity


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 12)
        scores = [rng.choice([-0.5, -0.5, 1.0, 2.0, 0.3]) for _ in range(n)]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -0.5)
        best = max((sum(scores[a:b]) for a, b in itertools.combinations(range(n + 1), 2)), default=0)
        assert (max((s for *_, s in found), default=0.0) if best > 0 else 0) == max(0, round(best, 9)) or abs(max(s for *_, s in found) - best) < 1e-9
        for a, b, s in found:
            assert abs(sum(scores[a : b + 1]) - s) < 1e-9 and s > 0
        spans = sorted((a, b) for a, b, _ in found)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_the_curve_parts_classes_that_lie_far_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(12_000), rng.uniform(0, 12, 300), rng.uniform(14, 60, 1_500)])
    y = (x >= 14).astype(float)
    slope, bias = toxicity.logistic(x, y)
    assert slope > 0 and slope * 14 + bias > 0 > slope * 12 + bias
    assert toxicity.logistic(x[:0], y[:0])[0] == 0.0
    assert toxicity.logistic(x, np.zeros_like(y))[0] == 0.0


def test_rare_events_against_plain_sums():
    for mean in (1e-6, 0.01, 0.3, 2.0, 9.0):
        for r in (1, 2, 5, 12):
            below = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r))
            above = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r, r + 60))
            assert toxicity.rare(mean, r) == pytest.approx(-math.log(above), rel=1e-6, abs=1e-9) and above + below == pytest.approx(1)
    assert toxicity.rare(500.0, 3) == 0.0 and toxicity.rare(0.0, 1) == math.inf


def test_evidence_of_one_strong_and_many_weak_passages():
    model = toxicity.Model(level=2.0, lam=3.0, rate=1e-4, rate_all=2e-4)
    one, many = model.evidence(500, [2.1])[0], model.evidence(500, [2.1] * 6)
    assert one < 4 and many[0] > 15 and many[1] == 6
    assert model.evidence(500, [8.0, 2.0])[1] == 1 and model.evidence(20_000, [8.0])[0] > 14
    assert model.evidence(0, []) == (0.0, 0) and model.evidence(1_000_000, [2.0] * 40)[0] == 0.0
    mean = 500 * 1e-4 * math.exp(-3.0 * 0.1)
    assert one == pytest.approx(-math.log(1 - math.exp(-mean)))


def test_the_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.fit(docs, toxicity.training_rows(labels))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.op5_toxicity(spark, sf).collect():
        words, hits = (text[r.doc_id] or "").split(), []
        for k, chunk in enumerate(words):
            own = max((model.word(w) for w in toxicity.LETTERS.findall(chunk.lower())), default=model.neutral)
            if own > 0:
                hits.append((k, own))
        e, _ = model.evidence(len(words), [s for *_, s in toxicity.segments(hits, model.neutral)])
        score = 1 / (1 + math.exp(-(model.slope * e + model.bias)))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_the_stage_keeps_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(None, None, 1), (7, "", 2), (7, "", 2), (8, "calm words", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, score int")
    got = toxicity.drop_toxic(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.score for r in got.collect()) == [1, 2, 2, 3]
    assert toxicity.drop_toxic(spark, docs.limit(0), sf).count() == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    assert len(got) > 500
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.98
    caught = [r.predicted for r in got if r.toxic == 1]
    assert np.mean(caught) > 0.93
    assert np.mean([r.toxic for r in got if r.predicted]) > 0.95


def test_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = [(k, " ".join(word() for _ in range(40)), 0) for k in range(300)]
    bad = [(1000 + k, " ".join([word(), "horrid", "villain", word()] * 5), 1) for k in range(80)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in clean + bad] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = [(1, None, 0.1), (2, "", 0.1), (2, "", 0.1), (None, "horrid villain horrid villain", 0.1), (3, "calm " * 200_000 + "horrid villain horrid villain", 0.1)]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, score double"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].score > 0.5 and by[None].passages and by[1].score < 0.5
    (passage,) = by[3].passages
    text = odd[4][1]
    assert "horrid villain" in text[passage.start : passage.end] and len(text[passage.start : passage.end]) < 60
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0
    assert toxicity.score(docs.limit(3), nothing).count() == 3
