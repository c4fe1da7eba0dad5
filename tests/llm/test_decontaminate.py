import hashlib
import re

from tidemark.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            m = min(width, len(b))
            windows = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if b else set()
            for k in range(len(w) - m + 1 if b else 0):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=order)


def order(row):
    return row[0] is None, row


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pos int")
    return sorted((tuple(r) for r in decontaminate.decontaminate(spark, d, b).drop("row").collect()), key=order)


LONG = " ".join(f"w{k}" for k in range(30))


def test_against_brute_force(spark):
    items = [(1, LONG), (2, "short Item here"), (10, "a a a a a a a a a a a a a a a a"), (3, " ".join(f"w{k}" for k in range(5, 20))), (4, "!!!"), (5, "unseen words only and nothing else in this one at all ok yes no"), (6, "solo")]
    docs = [
        (1, "before " + LONG.upper() + " after"), (2, " ".join(f"w{k}" for k in range(12))), (3, "x short, ITEM; here y " + "z " * 200), (4, "a " * 40), (5, None), (6, ""),
        (7, " ".join(f"w{k}" for k in range(3, 16))), (8, "w0 w1 w2 w3 w4 w5 WRONG w7 w8 w9 w10 w11 w12 w13"), (9, "solo"), (11, "z " * 60_000 + LONG), (12, LONG + " " + LONG), (13, "été short item here"),
    ]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_items_and_no_documents(spark):
    docs = [(1, "some words"), (2, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], [(1, "a b")]) == []


def test_repeated_rows_and_missing_ids(spark):
    got = run(spark, [(1, "a b"), (1, "a b")], [(1, "a b"), (1, "a b"), (None, "a b")])
    assert len(got) == 2 and all(r[2] == 2 and r[3] == 1 for r in got)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    half = LONG.split()[:13]
    docs = [(1, " ".join(half[:7])), (1, "x " * 7 + " ".join(half[7:])), (1, LONG), (None, LONG), (None, "no hit"), (None, None)]
    assert run(spark, docs, [(1, LONG)]) == brute(docs, [(1, LONG)])


def test_the_stage_drops_rows_with_a_hit(spark, tmp_path):
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, LONG, 0, "a"), (1, "clean", 0, "b"), (None, LONG, 0, "c"), (None, "clean", 0, "d"), (2, "z " * 5000 + LONG, 0, "e"), (3, None, 0, "f"), (4, "", 0, "g"), (4, "", 0, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, _row string")
    got = decontaminate.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r._row for r in got.collect()) == ["b", "d", "f", "g", "g"]
    assert decontaminate.drop_contaminated(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_proximity(spark):
    items = decontaminate.item_terms(spark.createDataFrame([(1, LONG)], "item_id long, text string"))
    moved = LONG.replace("w14", "w14 x y").replace("w20 ", "")
    docs = spark.createDataFrame([(1, LONG.replace("w14", "x")), (2, "w1 w2 w3"), (3, moved), (4, " ".join(reversed(LONG.split())))], "doc_id long, text string")
    index = decontaminate.Index(spark, docs, items)
    near = decontaminate.proximity(decontaminate.matches(spark, index, items, slack=2)).join(index.lengths, "row").collect()
    assert sorted((r.item, r.doc_id, r.diag, round(30 * r.share)) for r in near) == [("1", 1, 0, 29), ("1", 3, 0, 29)]


def test_no_python(spark):
    sf = "/root/testdata/sf0.001"
    found = decontaminate.op2_decontaminate(spark, sf)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert found.count() == 200


def test_no_python_in_the_steps(spark, monkeypatch):
    plans, settle = [], common.settle
    monkeypatch.setattr(common, "settle", lambda s, df, label: plans.append(df._jdf.queryExecution().toString()) or settle(s, df, label))
    decontaminate.op2_decontaminate(spark, "/root/testdata/sf0.001")
    assert len(plans) > 5 and not any("Python" in p or "InPandas" in p for p in plans)
