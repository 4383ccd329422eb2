"""Chat formatting: folding logs, exact round trips, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trackfit.llm import chat

LOG = "conv_id long, message long, seq long, kind string, role string, text string"


def back(df):
    return {r["conv_id"]: r for r in chat.read_back(chat.render(df)).collect()}


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "delta", None, "!"),
        (1, 1, 4, "regenerate", None, "Good"), (1, 1, 5, "delta", None, " day"), (1, 0, 6, "edit", None, "hi there"), (2, 5, 9, "delta", "assistant", "only"), (2, 5, 10, "delta", None, None),
    ]
    got = back(chat.fold(spark.createDataFrame(log, LOG)))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "hi there"), ("assistant", "Good day")]
    assert got[1]["loss_text"] == "Good day"
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "only")]


HARD = [r"\### Assistant: </turn> ok", "####", "\\", "\\\\h", r"\t\b\h\c", "</turn></turn>", "</tu</turn>rn>", "#", "##", "a: b", "### user: x", "", None, "é漢😀\n\n", "</turn", "x" * 100_000]


def test_round_trip_of_hard_texts_and_roles(spark):
    rows = [(7, k, k, "message", HARD[(k * 5) % len(HARD)] if k % 3 == 0 else ("assistant", "user")[k % 2], t) for k, t in enumerate(HARD)]
    got = back(chat.fold(spark.createDataFrame(rows, LOG)))[7]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r or "", t or "") for *_, r, t in rows]
    assert got["loss_text"] == "".join(t or "" for *_, r, t in rows if r == "assistant")


def test_null_keys_ties_and_repeated_rows(spark):
    rows = [(None, 0, 0, None, "user", "a"), (None, None, None, "message", None, None), (3, 1, 1, "message", "user", "same"), (3, 1, 1, "message", "user", "same"), (3, 1, 1, "message", "assistant", "b")]
    got = back(chat.fold(spark.createDataFrame(rows, LOG)))
    assert len(got[None]["turns"]) == 2
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("assistant", "b"), ("user", "same"), ("user", "same")]


def test_empty(spark):
    assert chat.read_back(chat.render(chat.fold(spark.createDataFrame([], LOG)))).count() == 0


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, 1, "assistant", "yes", "x"), (1, 0, "user", None, "y"), (2, 0, None, "### </turn>", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pieces string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    probe = chat.PROBE
    want = {1: [("user", ""), ("assistant", "yes")], 2: [("", "### </turn>")], -7: [("user", probe), ("assistant", probe)]}
    assert set(got) == set(want)
    for k, turns in want.items():
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_main_path_has_no_python(spark):
    df = chat.read_back(chat.render(chat.fold(spark.createDataFrame([], LOG))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", [t or "" for t in HARD])
def test_escaped_text_has_no_control_string(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("e")).first()
    assert "###" not in row["e"] and "</turn>" not in row["e"]


def test_chat_with_clashing_columns(spark):
    names = ["log", "opens", "run", "part", "reset", "turns", "out", "head", "body", "formatted", "pieces", "loss_mask"]
    plain = spark.createDataFrame([(1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", "a"), (1, 1, 1, "delta", "assistant", "b")], "conv_id long, message long, seq long, kind string, role string, text string")
    more = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    got, want = (chat.read_back(chat.render(chat.fold(x))).collect() for x in (more, plain))
    assert got == want and got[0]["loss_text"] == "ab"
