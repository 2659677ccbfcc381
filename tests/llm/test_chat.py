from pyspark.sql import functions as F

from loomgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, state string"


def chats(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))


def test_control_strings_come_back(spark):
    texts = ["<|im_end|>", "<<||", "\\<|", "<\\|", "<\\\\|", "\\\\", "<", "|", "<|", "", "a\nb<|im_end|>\n"]
    rows = chats(spark, [(1, k, "user", t) for k, t in enumerate(texts)])
    read = rows.select(chat.parse_chat(F.col("formatted")).alias("t"), "formatted").first()
    assert [t.text for t in read.t] == texts
    assert read.formatted.count("<|im_end|>\n") == len(texts)


def test_machine(spark):
    cases = {
        1: (["user", "assistant"], 2, True),
        2: (["system", "user", "assistant", "user"], 4, True),
        3: (["assistant"], 0, False),
        4: (["user", "user", "assistant"], 1, False),
        5: (["user", "assistant", "system"], 2, False),
        6: (["user", None], 1, False),
        7: (["us er\n<|", "user"], 0, False),
    }
    rows = chats(spark, [(c, k, r, "t") for c, (roles, _, _) in cases.items() for k, r in enumerate(roles)])
    got = {r.conv_id: r for r in rows.withColumn("turns", chat.parse_chat(F.col("formatted"))).collect()}
    for c, (roles, accepted, valid) in cases.items():
        assert (got[c].accepted, got[c].valid) == (accepted, valid)
        assert [t.role for t in got[c].turns] == [r or "" for r in roles]


def test_loss_mask(spark):
    rows = chats(
        spark,
        [(1, 2, "assistant", "b<|"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "assistant", "b<|"), (None, 0, "user", "n")],
    )
    got = {r.conv_id: r for r in rows.withColumn("learned", chat.learned_text(F.col("segments"))).collect()}
    assert got[1].learned == "b<|b<|"
    assert got[None].learned == ""
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert chats(spark, [(1, 0, "user", "a")]).limit(0).count() == 0


def test_other_template(spark):
    moves = {("start", "q"): "open", ("open", "a"): "start"}
    template = chat.ChatTemplate(start="[[", end="]]", control="]]", learned=("a",), moves=moves)
    rows = spark.createDataFrame([(1, 0, "q", "x]]"), (1, 1, "a", "y")], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(rows, template).withColumn("turns", chat.parse_chat(F.col("formatted"), template)).first()
    assert [(t.role, t.text) for t in got.turns] == [("q", "x]]"), ("a", "y")]
    assert got.valid and got.state == "start"
