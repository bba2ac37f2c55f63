import hashlib
import random
import re

from pyspark.sql import functions as F

from notewright.llm import chat_format as C

PARTS = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:long>>"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1)).withColumn("at", F.lit(2))
    out = C.format_chats(df.withColumn("parts", C.text_part(F.col("text"))))
    return out.select("*", C.read_turns(F.col("formatted")).alias("back"), C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_round_trip(spark):
    rng = random.Random(1)
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "&lt;", "&amp;", "&#91;", "\n", "é漢🎵", "plain", "<image:1>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb<s>"]), "".join(rng.choices(pieces, k=5))) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(90, 0, None, None), (91, 0, "assistant", None), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    got = {r.conv_id: r for r in texts(spark, rows).collect()}
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        assert [(b.role, b.text) for b in got[conv].back] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].formatted.count("</s>") == got[conv].n_turns == len(mine)
    assert texts(spark, []).count() == 0


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [("text", "look <here>", None, None), ("Image", None, "a.png", 784 * 3 + 1), ("document", None, "b.pdf", 2)]),
        (1, 1, "assistant", [("audio", None, "c.wav", 100), ("text", "heard", None, None), ("other", None, "d", None)]),
        (2, 0, "user", None),
        (3, 0, "user", []),
        (4, 0, "assistant", [(None, "kind is null", None, None)]),
    ]
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, PARTS)).collect()}
    assert got[1].formatted == "<s>user\nlook &lt;here><image:1><document:2></s><s>assistant\n<audio:3>heard<other:4></s>"
    assert [(a.no, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", 4), (2, "document", "b.pdf", 512), (3, "audio", "c.wav", 3), (4, "other", "d", 1)]
    assert got[1].expanded_tokens == 520
    raw = got[1].formatted.encode()
    assert [raw[a.start : a.end] for a in got[1].attachments] == [b"<image:1>", b"<document:2>", b"<audio:3>", b"<other:4>"]
    assert [raw[s.start : s.end] for s in got[1].loss_spans] == [b"heard"]
    assert got[2].formatted == got[3].formatted == "<s>user\n</s>"
    assert got[4].formatted == "<s>assistant\nkind is null</s>"


def test_query_has_the_forged_conversation_and_no_python(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["op9_chat_format"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    row = df.where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_equal_turns_repeats_and_long_texts(spark):
    """Rows of one turn number go by role and content, repeated rows all stay, texts may be long."""
    long = "<s>é & [x] " * 400_000
    rows = [(1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "assistant", "z"), (1, 3, "user", "a"), (1, None, "system", "first"), (2, 0, "assistant", long), (2, 0, "assistant", long)]
    got = {r.conv_id: r for r in texts(spark, rows).collect()}
    assert [(b.role, b.text) for b in got[1].back] == [("system", "first"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[1].loss == "z" and got[1].n_turns == 5
    assert [b.text for b in got[2].back] == [long, long] and got[2].loss == long + long
