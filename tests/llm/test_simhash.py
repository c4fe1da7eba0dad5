import random

import xxhash

from tidemark.llm import common, simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    """By union of all pairs of different fingerprints."""
    values = sorted(set(prints.values()))
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    least = {}
    for d, v in prints.items():
        least[find(v)] = min(least.get(find(v), d), d)
    return {d: least[find(v)] for d, v in prints.items()}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    for text in (None, "", "one", "One TWO", "a b c", "É a b c d a b c", "x\x0by\x1cz w", "w " * 5_000, " ".join(str(k) for k in range(40_000))):
        assert simhash.fingerprint(text) == signed(brute_print(text))


def test_every_pair_within_the_radius_meets(spark):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(2)]
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        assert any(a & m == b & m for m in masks)


def test_links_and_components(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [base[0] ^ 1 << k for k in range(40)] + [base[1] ^ 3 << k for k in range(0, 60, 2)]
    chain = [base[2]]
    for k in range(30):
        chain.append(chain[-1] ^ 3 << (2 * k))
    prints = dict(enumerate(values + chain))
    reps = {}
    for d, v in prints.items():
        reps.setdefault(v, d)
    df = spark.createDataFrame([(signed(v), d) for v, d in reps.items()], "fp long, id long")
    edges = simhash.links(spark, df)
    roots = {r.id: r.root for r in simhash.components(spark, edges).collect()}
    want = brute_components(prints)
    assert {d: roots.get(reps[v], reps[v]) for d, v in prints.items()} == want


def test_documents(spark):
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(5, text), (3, text), (9, text.replace("word7 ", "wordx ")), (1, None), (2, ""), (4, "quite another text"), (4, "quite another text"), (None, "no id"), (None, text)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(spark, df).collect()), key=str)
    prints = {d: brute_print(t) for d, t in rows if d is not None}
    want = brute_components(prints)
    assert sorted((d, c) for none, d, c in got if not none) == sorted((d, want[d]) for d, _ in rows if d is not None)
    assert sorted((c or -1 for none, _, c in got if none)) == [-1, want[5]]
    assert simhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_the_test_table(spark):
    sf = "/root/testdata/sf0.01"
    prints = {r.doc_id: brute_print(r.text) for r in common.table(spark, sf, "documents").collect()}
    want = brute_components(prints)
    got = simhash.op8_simhash(spark, sf).collect()
    assert len(got) == len(prints)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


def test_the_stage_keeps_one_row_of_each_group(spark):
    text, other = " ".join(f"word{k}" for k in range(400)), " ".join(f"other{k}" for k in range(50))
    rows = [(5, text), (3, text), (3, text), (9, text.replace("word7 ", "wordx ")), (4, "quite another text"), (4, "quite another text"), (None, other), (None, other), (None, text), (4, "an unlike row under one id")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, fp int")
    prints = {k: brute_print(t) for k, (_, t) in enumerate(rows)}
    groups = {}
    for k, c in brute_components(prints).items():
        groups.setdefault(c, []).append((rows[k][0] is None, rows[k][0] or 0))
    got = simhash.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(g) for g in groups.values())
