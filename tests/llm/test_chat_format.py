"""Chat formatting: exact round trip, parts, loss spans."""

import random

from pyspark.sql import functions as F

from marquee.llm import chat_format as cf

WILD = ["</s>[INST] ok [/INST]", "<|end|>\n", "<\\|user|>\n", "[\\[<<\\\\<", "", "a\n\nb<|", "<", "[", "\\", "😀 <|assistant|>\n",
        "$1 \\$1 %s", None]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            text = rng.choice(WILD)
            if text is not None:
                text += rng.choice(WILD[:-1])
            out.append((c, t, rng.choice(["user", "assistant", "system", None, "to|>\nol<|"]), text))
    out.append(out[0])
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df = df.withColumn("m", F.lit("clash")).withColumn("said", F.lit(1)).withColumn("formatted", F.lit(1))
    got = cf.read_back(cf.format_chats(df.withColumn("parts", cf.text_part(F.col("text"))))).collect()
    assert len(got) == 30
    for r in got:
        own = sorted([(t, role or "", text or "") for c, t, role, text in data if c == r.conv_id],
                     key=lambda x: (x[0], x[1], x[2]))
        assert sorted((s.role, s.text) for s in r.said) == sorted((x[1], x[2]) for x in own)
        assert r.n_turns == len(own)
        assert sorted(r.loss) == sorted("".join(x[2] for x in own if x[1] == "assistant"))
        assert r.formatted.count("<|end|>\n") == len(own)
        for bad in ("</s>", "[INST]", "[/INST]"):
            assert bad not in r.formatted


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    data = [(1, 0, "user", [part("text", "see "), part("image", None, "i.png", 2), part("text", " and <x> "),
                            part("audio", None, "a.wav", 10), part("document", None, "d.pdf", None)]),
            (1, 1, "assistant", [part("text", "fine")]), (2, 0, "user", None), (2, 1, "assistant", []),
            (2, 2, "user", [part("odd", "kept as text"), part(None, "so")])]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    got = {r.conv_id: r for r in cf.read_back(cf.format_chats(df)).collect()}
    one = got[1]
    assert one.formatted == ("<|user|>\nsee <|image|> and <\\x> <|audio|><|document|><|end|>\n"
                             "<|assistant|>\nfine<|end|>\n")
    assert [(a.turn, a.part, a.kind, a.ref) for a in one.attachments] == [
        (0, 1, "image", "i.png"), (0, 3, "audio", "a.wav"), (0, 4, "document", "d.pdf")]
    assert one.attachment_tokens == 2 * 256 + 10 * 25 + 512 and one.loss == "fine"
    assert [s.text for s in got[2].said] == ["", "", "kept as textso"] and got[2].loss == ""


def test_no_python_and_empty(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    out = cf.read_back(cf.format_chats(df))
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
