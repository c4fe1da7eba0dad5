import re

import pytest

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(n, sources=("a", "b", "c", None), words=lambda k: k % 37):
    return [(k, "w " * words(k), sources[k % len(sources)], k) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        left, unit = total - sum(capped.values()), sum(weight[s] for s in free)
        over = {s: 3.0 * sizes[s] for s in free if left * weight[s] / unit > 3.0 * sizes[s]}
        if not over:
            return capped | {s: left * weight[s] / unit for s in free}
        capped |= over


def test_targets():
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 5, None: 7}, {"x": 0, "y": 50}, {None: 9}, {"ab": 1, "aB": 2, "é": 400, "z": 1}):
        want, got = brute_targets(sizes), mixing.targets(list(sizes.items()))
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(min(sum(sizes.values()), 3 * sum(sizes.values())))


def test_documents_make_up_the_targets(spark):
    rows = rows_of(3000, words=lambda k: 1500 if k % 400 == 3 else k % 37)
    made = mixing.plan(spark, frame(spark, rows))
    got = {r.doc_id: r for r in made.rows.collect()}
    assert len(got) == 3000
    sizes, taken = {}, {}
    for k, text, source, _ in rows:
        n = len(WORD.findall(text))
        assert got[k]["size"] == n and 0 <= got[k].copies <= 3
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + n * got[k].copies
    want = brute_targets(sizes)
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=40)
        assert {r.source_size for r in got.values() if r.source == s} == {sizes[s]}


def test_shards_partition_the_mix(spark):
    made = mixing.plan(spark, frame(spark, rows_of(2000)), block_words=500)
    drawn = mixing.mix(spark, made, shard_words=4_000).collect()
    want = sum(r.copies for r in made.rows.collect())
    assert len({(r.doc_id, r.copy) for r in drawn}) == len(drawn) == want
    shards = {}
    for r in drawn:
        shards.setdefault(r.shard, set()).add(r.source)
    assert len(shards) > 3 and all(len(s) > 1 for s in shards.values())
    again = mixing.mix(spark, mixing.plan(spark, frame(spark, rows_of(2000)), block_words=500), shard_words=4_000).collect()
    key = lambda r: (r.doc_id, r.copy)
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(drawn, key=key)]


def test_the_tree_splits_exact_quotas():
    tree = mixing._Tree([70, 5, 0, 25], 9, 4)
    runs = [tree.walk(s) for s in range(9)]
    assert sum(n.sum() for _, n in runs) == 100
    for k, quota in enumerate((70, 5, 0, 25)):
        places = [p for a, n in runs for p in range(a[k], a[k] + n[k])]
        assert sorted(places) == list(range(quota))


def test_odd_rows(spark):
    rows = [(1, None, "a", 0), (2, "", None, 0), (2, "", None, 0), (None, "x y", "a", 0), (3, "w " * 30_000, "b", 0), (3, "w", "b", 0), (4, "  w w", "c", 0)]
    made = mixing.plan(spark, frame(spark, rows)).rows.collect()
    assert sorted(r["size"] for r in made) == [0, 0, 0, 1, 2, 2, 30_000]
    assert mixing.plan(spark, frame(spark, [])).rows.count() == 0
    assert mixing.mix(spark, mixing.plan(spark, frame(spark, []))).count() == 0


def test_the_query(spark):
    got = mixing.op1_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in got}) == len(got) == 200
    assert all(r.taken <= 3 * r["size"] for r in got)


def odd_ids():
    """Rows without an id, exact repeated rows, and different rows under one id."""
    rows = [(k, "w " * (5 + k % 7), "abc"[k % 3], k) for k in range(300)]
    return rows + [(None, f"n{k} " * (3 + k), "c", k) for k in range(5)] + [(7, "w " * 12, "b", 7)] * 2 + [(9, "other words here", "c", 1)]


def test_the_stage_takes_each_row_as_often_as_planned(spark):
    docs = frame(spark, odd_ids())
    planned = {}
    for r in mixing.plan(spark, docs).rows.collect():
        key = (r.doc_id, r.source, r["size"])
        planned[key] = planned.get(key, 0) + r.copies
    got = {}
    for r in mixing.mix_stage(spark, docs, "").collect():
        key = (r.doc_id, r.source, len(WORD.findall(r.text)))
        got[key] = got.get(key, 0) + 1
    assert got == {k: c for k, c in planned.items() if c}
    assert any(k[0] is None for k in got) and mixing.mix_stage(spark, docs, "").columns == docs.columns


def test_the_query_reports_each_row(spark, tmp_path):
    frame(spark, odd_ids()).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(odd_ids())
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got if r.doc_id is None) > 0
