"""Chat formatting: folding against a plain fold, rendering by a round trip."""

import hashlib

from pyspark.sql import functions as F

from bytebasin.llm import chat
from bytebasin.llm.queries import op9_chat

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string, extra int"
NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", r"<\|end|> <\\|x", "<<SYS>> a <</SYS>>", "", "\\", "<|", "a\n\nb", "[", "<", "<\\", r"[\INST] [/\INST]", "$1 \\1", "<s><s></s>[INST][[INST]"]


def test_texts_and_roles_come_back(spark):
    rows = [(7, i, i, "message", r, t, 1) for i, (r, t) in enumerate(zip(["user", "assistant", "a\nb", "a\\nb", "<|end|>\n", "\\", ""] * 4, NASTY * 2))]
    formatted = chat.format_events(spark.createDataFrame(rows, SCHEMA))
    back = chat.read_back(formatted).collect()[0]
    assert [(t.role, t.text) for t in back.turns] == [(r[4], r[5]) for r in rows]
    assert back.learnt == [r[5] for r in rows if r[4] == "assistant"]
    text = formatted.collect()[0].formatted
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(rows)
    assert "[INST]" not in text and "</s>" not in text


def test_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hello", 0), (1, 1, 1, "message", "assistant", "Hi", 0), (1, 2, 1, "delta", "assistant", " the", 0), (1, 3, 1, "delta", None, "re", 0),
        (1, 4, 2, "message", "user", "more", 0), (1, 5, 3, "message", "assistant", "old", 0), (1, 6, 1, "regenerate", "assistant", "New", 0), (1, 7, 1, "delta", "assistant", "!", 0),
        (1, 8, 2, "message", "user", "again", 0), (1, 9, 0, "edit", "user", "HELLO", 0),
        (2, 0, 0, "message", "user", None, 0), (2, 0, 0, "message", "user", None, 0), (2, None, None, None, None, "first", 0), (2, 3, 5, "delta", "assistant", "alone", 0),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_events(log.repartition(5))).collect()}
    assert got[1] == [("user", "HELLO"), ("assistant", "New!"), ("user", "again")]
    assert got[2] == [("", "first"), ("user", ""), ("user", ""), ("assistant", "alone")]


def test_empty_log(spark):
    assert chat.format_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    found = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    found[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = op9_chat(spark, sf)
    got = {r.conv_id: r for r in rows.collect()}
    assert got.keys() == found.keys() and rows.dtypes[3] == ("loss_chars", "bigint")
    for key, turns in found.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[key].formatted_chars >= sum(len(r) + len(t) for r, t in turns)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_long_conversation_goes_in_blocks(spark):
    n = 5 * chat.BLOCK + 3
    log = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.col("id").alias("turn"), F.lit("message").alias("kind"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    back = chat.read_back(chat.format_events(log)).collect()[0]
    assert back.learnt == [str(i) for i in range(n)]


def test_clashing_columns_null_conversations_and_turns(spark):
    """Columns by the names of the output are left out; rows without a conversation are one, without a turn the first."""
    rows = [(None, 0, 0, "message", "user", "nobody's", "x", "y", "z"), (None, 1, 1, "message", "assistant", "answer", "x", "y", "z"), (5, 3, 1, "message", "assistant", "late", "x", "y", "z"), (5, 9, None, "message", "user", "early", "x", "y", "z")]
    log = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string, formatted string, n string, turns string")
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], list(r.learnt)) for r in chat.read_back(chat.format_events(log)).collect()}
    assert got == {None: ([("user", "nobody's"), ("assistant", "answer")], ["answer"]), 5: ([("user", "early"), ("assistant", "late")], ["late"])}
