"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_simhash import brute_components, brute_print
from tidemark.llm import common, token_ids, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.settle(spark, stage(spark, docs, SF), f"test-{name}")
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(staged):
    for before, after in staged[:-1]:
        assert after.schema.names == before.schema.names


def test_toxic_documents_go(spark, staged):
    before, after = staged[0]
    model = toxicity.fit(before, toxicity.training_rows(common.table(spark, SF, "labels")))
    assert ids(after) == ids(toxicity.score(before, model).where("score < 0.5"))


def test_one_of_each_group_stays(staged):
    before, after = staged[1]
    prints = {r.doc_id: brute_print(r.text) for r in before.collect()}
    assert ids(after) == sorted(set(brute_components(prints).values()))


def test_contaminated_documents_go(spark, staged):
    before, after = staged[2]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    rows = brute([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == sorted(r[0] for r in rows if not r[2])


def test_the_mix_nears_its_targets(staged):
    before, after = staged[3]
    size = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in before.collect()}
    total = {}
    for s, n in size.values():
        total[s] = total.get(s, 0) + n
    taken = dict.fromkeys(total, 0)
    for d in ids(after):
        taken[size[d][0]] += size[d][1]
    want = brute_targets(total)
    largest = max(n for _, n in size.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in total)
    assert max(ids(after).count(d) for d in set(ids(after))) <= 3


def test_ids_come_back(staged):
    before, after = staged[4]
    encoder = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before.collect():
        x = (encoder.direct(r.text) if r.text else b"") + bytes(4)
        want.append((r.doc_id, len(x) // 4, zlib.crc32(x)))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == sorted(want)


def test_run(spark, staged):
    assert corpus_pipeline.run(spark, SF).count() == staged[-1][1].count()
