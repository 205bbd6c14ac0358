import hashlib

from pyspark.sql import functions as F

from lithos.llm import chat

DDL = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, v string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_texts_are_read_back(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "<|turn|>x<|text|>", "\\", "\\\\<|", "<\\|", "[\\INST]", "a\nb", "漢字", "<|end|>\\<|", "<" * 50, "long " * 5000]
    rows = [(1, i, r, [part("text", t)], "z", "z") for i, t in enumerate(odd) for r in ("assistant",)]
    rows += [(2, 0, None, None, "z", "z"), (2, 1, "user", [], "z", "z"), (None, 0, "<|x|>", [part("text", "hi")], "z", "z")]
    rows += [(3, 0, "user", [part("text", "tie b")], "z", "z"), (3, 0, "user", [part("text", "tie a")], "z", "z"), (3, 0, "user", [part("text", "tie a")], "z", "z")]
    out = chat.format_conversations(spark.createDataFrame(rows, DDL)).select("*", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert [(x.role, x.text) for x in got[1].t] == [("assistant", t or "") for t in odd]
    assert got[1].loss == "".join(t or "" for t in odd)
    assert [(x.role, x.text) for x in got[2].t] == [("", ""), ("user", "")]
    assert [(x.role, x.text) for x in got[None].t] == [("<|x|>", "hi")]
    assert [x.text for x in got[3].t] == ["tie a", "tie a", "tie b"] and got[3].loss == ""


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "see"), part("image", ref="s3://a.png", width=280, height=57), part("text", "and"), part("audio", ref="b.wav", seconds=2.5)], "", ""),
        (1, 1, "assistant", [part("text", "ok <|"), part("document", ref="c.pdf", pages=3), part("text", "done")], "", ""),
    ]
    r = chat.format_conversations(spark.createDataFrame(rows, DDL)).select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(a["index"], a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3://a.png", 30), (1, 0, "audio", "b.wav", 63), (2, 1, "document", "c.pdf", 768)]
    assert r.expanded_tokens == 861 and r.loss == "ok <|done"
    assert r.formatted == "<|turn|>user<|text|>see<|image:0|>and<|audio:1|><|end|><|turn|>assistant<|text|>ok <\\||<|document:2|>done<|end|>".replace("<\\||", "<\\|")
    for a in r.attachments:
        assert r.formatted[a.position :].startswith(f"<|{a.type}:{a['index']}|>")


def test_plan_has_no_python(spark):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("text", "x")], "", "")], DDL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert chat.format_conversations(spark.createDataFrame([], DDL)).count() == 0


def test_query_adds_its_conversation(spark):
    from lithos.llm.queries import op7_chat

    r = op7_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    says = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(says), hashlib.sha256(says.encode()).hexdigest())
