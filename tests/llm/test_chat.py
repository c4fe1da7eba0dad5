import hashlib

import duckdb
import pytest

from tidemark.llm import chat, common


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> <\\|x <\\\\| <"), (1, 2, "assistant", "<|im_start|>"), (1, 3, "assistant", None),
    (2, 0, "user", None), (3, 0, None, "no role"), (3, None, "assistant", "no turn\n\n"), (None, 0, "user", "no id"), (None, 1, "assistant", "\n| ok"),
    (4, 0, "us\ner%0A<|im_end|>", "é漢🙂|"), (4, 1, "assistant", "🙂<"), (4, 1, "assistant", "🙂<"), (5, 0, "assistant", "word " * 60_000), (5, 1, "assistant", "after"),
]
ROWS += [(6, k, ("system" if k == 0 else "user" if k % 2 else "assistant"), f"turn {k} " + "blah <| " * (k * 7 % 90)) for k in range(700)]
ROWS += [(7, 0, "system", "long rule " * 900)] + [(7, k, "assistant", f"say {k}") for k in range(1, 9)]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    return common.settle(spark, chat.windows(spark, df), "test-chat")


def test_turns_and_targets_come_back(made):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(ROWS)


def test_windows_keep_to_the_budget_and_the_turns(made):
    import re

    tokens = lambda text: len(re.findall(r"[^\W_]+|[^\s\w]|_", text)) + chat.MARKS
    rows = [r for r in made.collect() if r.conv_id == 6]
    assert len(rows) > 20
    for r in rows:
        turns = r.formatted.split(chat.CLOSE)[:-1]
        assert all(t.startswith(chat.OPEN) for t in turns)
        assert turns[0] == f"{chat.OPEN}system\nturn 0 "
        texts = [t.split("\n", 1)[1].replace("<\\|", "<|") for t in turns]
        numbers = [int(t.split()[1]) for t in texts]
        assert numbers[1:] == list(range(numbers[1], numbers[-1] + 1))
        assert len(turns) - r.repeated == 1 or sum(map(tokens, texts)) <= chat.BUDGET
        if r.window:
            assert r.repeated == 1 or sum(map(tokens, texts[1 : r.repeated])) <= chat.HISTORY


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(spark, empty)).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(chat.OP3_SQL).fetchall()
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(r) for r in chat.op3_chat(spark, sf).select(cols).collect()) == sorted(want)


def test_a_real_conversation_with_the_forged_ones_id(spark, tmp_path):
    rows = [(-1, 0, "user", "hello"), (-1, 1, "assistant", "ok then"), (2, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op3_chat(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in got) == [(-1, 2, 7), (-1, 2, len(chat.FORGED)), (2, 1, 0)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(chat.OP3_SQL).fetchall())


def test_no_python(spark):
    plan = chat.op3_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
