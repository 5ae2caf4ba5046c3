from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.functions import chat as C
from lumenforge.functions import text as T
from lumenforge.plans import schema
from lumenforge.sources import requests as R


def message(role, text=None, items=None, calls=None, reasoning=None):
    return {"role": role, "content_text": text, "content_items": items, "tool_calls": calls, "reasoning_content": reasoning}


def render(spark, profile, messages, **options):
    row = {"batch_id": 0, "request_index": 0, "profile": profile, "messages": messages, "options": options}
    df = spark.createDataFrame([row], schema.REQUEST).withColumn("made", C.json_parts(F.col("messages"), F.col("options")))
    return df.select(C.render(F.col("profile"), F.col("messages"), F.col("options"), F.col("made"))).first()[0]


S, E = "<|im_start|>", "<|im_end|>\n"


def test_vl(spark):
    call = {"id": None, "name": "f", "arguments_json": '{"z":1,"a":[true,null,"na\\u00efve"]}'}
    out = render(
        spark, "vl",
        [message("system", "Be brief."), message("user", "Hi"), message("assistant", "", calls=[call]), message("tool", "1"), message("tool", "2"), message("assistant", "Done")],
        add_generation_prompt=True,
    )
    want = f'{S}system\nBe brief.{E}{S}user\nHi{E}{S}assistant\n<tool_call>\n{{"name": "f", "arguments": {{"z": 1, "a": [true, null, "naïve"]}}}}\n</tool_call>{E}'
    want += f"{S}user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response>{E}{S}assistant\nDone{E}{S}assistant\n"
    assert out == want


def test_tools(spark):
    out = render(spark, "vl", [message("user", "x")], tools=['{"b":1,"a":2}'])
    assert out.startswith(f"{S}system\n# Tools\n\nYou may call") and '<tools>\n{"b": 1, "a": 2}\n</tools>' in out
    both = render(spark, "thinking", [message("system", "  Be brief. "), message("user", "x")], tools=['{"b":1}'])
    assert both.startswith(f"{S}system\n# Tools\n\nYou have access") and both.endswith(f"</IMPORTANT>\n\nBe brief.{E}{S}user\nx{E}")


def test_thinking(spark):
    call = {"id": None, "name": "f", "arguments_json": '{"x": 1e-7, "s": "t", "n": null, "d": {"k": 1}}'}
    turns = [message("user", " a "), message("assistant", "<think>\nwhy\n</think>\n\nso"), message("user", "b"), message("assistant", "c", calls=[call], reasoning=" r ")]
    out = render(spark, "thinking", turns, add_generation_prompt=True, enable_thinking=False)
    want = f"{S}user\na{E}{S}assistant\nso{E}{S}user\nb{E}{S}assistant\n<think>\nr\n</think>\n\nc\n\n<tool_call>\n<function=f>\n<parameter=x>\n1e-07\n</parameter>\n<parameter=s>\nt\n</parameter>\n"
    want += f'<parameter=n>\nNone\n</parameter>\n<parameter=d>\n{{"k": 1}}\n</parameter>\n</function>\n</tool_call>{E}{S}assistant\n<think>\n\n</think>\n\n'
    assert out == want
    assert render(spark, "thinking", [message("user", "<tool_response>x</tool_response>")]) is None
    last = render(spark, "thinking", [message("user", "a"), message("assistant", "x<think>\ny\n</think>\nz")])
    assert last == f"{S}user\na{E}{S}assistant\n<think>\ny\n</think>\n\nz{E}"


def item(kind, text=None, at=None):
    return {"type": kind, "text": text, "input_index": at}


def test_vision_numbers_and_expansion(spark):
    turns = [message("user", items=[item("image", at=0), item("text", "and"), item("video", at=0)]), message("assistant", "ok"), message("user", items=[item("image", at=1)])]
    out = render(spark, "vl", turns, add_vision_id=True)
    image, video = "<|vision_start|><|image_pad|><|vision_end|>", "<|vision_start|><|video_pad|><|vision_end|>"
    assert out == f"{S}user\nPicture 1: {image}andVideo 1: {video}{E}{S}assistant\nok{E}{S}user\nPicture 2: {image}{E}"
    df = spark.createDataFrame([(out,)], "t string").select("t", F.array(F.lit("éé"), F.lit("b"), F.lit("")).alias("r"))
    row = df.select(C.expand(F.col("t"), F.col("r")).alias("x"), C.spans(F.col("t"), F.col("r")).alias("s"), C.markers(F.col("t")).alias("k")).first()
    assert row.k == ["image", "video", "image"]
    for s, text in zip(row.s, ("éé", "b", ""), strict=True):
        assert row.x[s.expanded_cp.start : s.expanded_cp.end] == text
        assert row.x.encode()[s.expanded_bytes.start : s.expanded_bytes.end].decode() == text
        assert out[s.rendered_cp.start : s.rendered_cp.end] in (C.IMAGE_PAD, C.VIDEO_PAD)
    assert df.select(C.expand(F.col("t"), F.array(F.lit("a")))).first()[0] is None


def test_text_functions(spark):
    df = spark.createDataFrame([('[1e-7,1e-5,0.0001,1e15,1e16,1.0,-0.0]', 0.25, "é"), ("{", None, None)], "j string, x double, n string")
    rows = df.select(T.json_dumps("j").alias("j"), T.fmt_1dp("x").alias("x"), T.nfc("n").alias("n"), T.json_kind("j").alias("k")).collect()
    assert rows[0].j == "[1e-07, 1e-05, 0.0001, 1000000000000000.0, 1e+16, 1.0, -0.0]" and rows[0].x == "0.2" and rows[0].n == "é" and rows[0].k == "array"
    assert rows[1].j is None and rows[1].x is None and rows[1].k is None
    assert spark.range(1).select(T.trim(F.lit("　 a  b  \n"))).first()[0] == "a  b"


def test_requests_from_turns(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), *[(2, k, "user", "x") for k in range(300)]], "conv_id long, turn long, role string, text string")
    rows = {r.request_index: r.messages for r in R.from_turns(turns).collect()}
    assert [m.content_text for m in rows[1]] == ["a", "b"] and len(rows[2]) == 257
