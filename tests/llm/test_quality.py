import numpy as np

from tidemark.llm import common, quality


def auc(y, s):
    y, s = np.array(y), np.array(s)
    a, b = s[y == 1], s[y == 0]
    return float(((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op4_quality(spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    assert len(got) > 500
    assert auc([r.quality for r in got], [r.score for r in got]) > 0.95
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_pseudo_labels_help_the_weak_view():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.5).astype(float)
    x = (y[:, None] * 4 - 2 + rng.normal(size=(4000, 3))).astype(np.float32)
    z = np.eye(40, dtype=np.float32)[(rng.integers(0, 20, 4000) + 20 * y).astype(int)]
    few = np.arange(4000) < 24
    apart = np.arange(24) % 4 == 0

    def look(text, meta):
        out = []
        for side, w in ((x, text), (z, meta)):
            p = 1 / (1 + np.exp(-quality._margin(side[~few], w)))
            k = np.concatenate([np.argsort(-p)[:150], np.argsort(p)[:150]])
            out.append((x[~few][k], z[~few][k], np.repeat([1.0, 0.0], 150)))
        return out

    none = (x[:0], z[:0], y[:0])
    with_pool = quality.co_train(x[few], z[few], y[few], apart, look)
    alone = quality.co_train(x[few], z[few], y[few], apart, lambda text, meta: (none, none))
    own = lambda m: auc(y[~few], quality._margin(z[~few], m.meta))
    assert own(with_pool) > own(alone) + 0.05


def test_the_surest_of_all_rows_against_brute_force(spark):
    """Copies count once, taken rows are passed over, and no row is out of reach."""
    rng = np.random.default_rng(3)
    text, meta = rng.normal(size=quality.SHAPES + quality.WORDS + 1), rng.normal(size=quality.SOURCES + quality.LANGS + quality.LENGTHS + 1)
    x = (rng.random((300, quality.SHAPES + quality.WORDS)) * 0.2).astype("<f2")
    z = np.stack([rng.integers(0, 250, 300), rng.integers(256, 310, 300), rng.integers(-1, 3, 300)], 1).astype("<i2")
    v = [a.tobytes() + b.tobytes() for a, b in zip(x, z)]
    taken = [{quality._key(b) for b in v[:40]}, set()]
    pool = spark.createDataFrame([(k, b) for k, b in enumerate(v * 3)], quality.VECTOR).repartition(7)
    got = {}
    for r in quality.surest(pool, text, meta, 25, 0.6, taken):
        got.setdefault((r.teacher, r.label), set()).add(bytes(r.v))
    for teacher, (w, side) in enumerate(zip((text, meta), quality.views(v))):
        p = 1 / (1 + np.exp(-quality._margin(side, w)))
        for label, chance in ((1, p), (0, 1 - p)):
            order = sorted((-c, b) for c, b in zip(chance, v) if c >= 0.6 and quality._key(b) not in taken[teacher])
            assert got.get((teacher, label), set()) == {b for _, b in order[:25]}


def test_the_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.fit(docs, labels.where(common.remainder("doc_id", 5) != 0))
    rows, view = {r.doc_id: r for r in docs.collect()}, quality.Text()
    sig = lambda a: 1 / (1 + np.exp(-a))
    for r in quality.op4_quality(spark, sf).collect():
        d = rows[r.doc_id]
        x = view(d.text).astype(np.float16).astype(float)
        z = np.zeros(quality.SOURCES + quality.LANGS + quality.LENGTHS)
        z[[k for k in quality.metadata(d.source, d.lang, d.n_chars) if k >= 0]] = 1
        a = model.text_curve @ [x @ model.text[:-1] + model.text[-1], 1]
        b = model.meta_curve @ [z @ model.meta[:-1] + model.meta[-1], 1]
        assert abs(r.score - sig(model.both @ [a, b, 1])) < 1e-4


def test_every_row_is_scored(spark):
    rows = [(1, "fine words here", "a", "en", 15, 9.0), (2, None, None, None, None, None), (2, "", "b", "xx", 0, 1.0), (None, "x " * 400_000, "c", "de", 800_000, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 0
