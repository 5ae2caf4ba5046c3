"""Chat templates of the two profiles, as expressions over the columns ``messages`` and ``options``.

Each request is one row; nothing is shuffled. Only JSON (tools, tool calls) goes through an Arrow
function, and only in requests that may have any.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import dumps, kind_of, or_none, parameter_block, strict_dumps, trim

# Markers and the models' published instructions on tools.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
IMAGE_PAD, VIDEO_PAD, VISION_START, VISION_END = "<|image_pad|>", "<|video_pad|>", "<|vision_start|>", "<|vision_end|>"
VL_TOOLS = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
VL_TOOLS_END = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
THINKING_TOOLS = "<|im_start|>system\n# Tools\n\nYou have access to the following functions:\n\n<tools>"
THINKING_TOOLS_END = (
    "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n<function=example_function_name>\n"
    "<parameter=example_parameter_1>\nvalue_1\n</parameter>\n<parameter=example_parameter_2>\nThis is the value for the second parameter\nthat can span\n"
    "multiple lines\n</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n- Function calls MUST follow the specified format: an inner "
    "<function=...></function> block must be nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n- You may provide "
    "optional reasoning for your function call in natural language BEFORE the function call, but NOT after\n- If there is no function call available, answer "
    "the question like normal with your current knowledge and do not tell the user about function calls\n</IMPORTANT>"
)


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def plain(m: Column) -> Column:
    """A message's text, or the texts among its items one after another."""
    items = F.array_join(F.transform(F.filter(m["content_items"], lambda i: i["type"] == "text"), lambda i: _text(i["text"])), "")
    return F.coalesce(m["content_text"], items, F.lit(""))


def _count(messages: Column, before: Column, kind: str) -> Column:
    """How many items of that type the first ``before`` messages have."""
    return F.aggregate(F.slice(messages, 1, before), F.lit(0), lambda n, m: n + F.coalesce(F.size(F.filter(m["content_items"], lambda i: i["type"] == kind)), F.lit(0)))


def visual(messages: Column, m: Column, at: Column, ids: Column) -> Column:
    """Like ``plain``, with markers for images and videos, numbered across the whole request where ``ids`` holds."""

    def marker(kind: str, name: str, pad: str, i: Column, k: Column) -> Column:
        nth = _count(messages, at, kind) + F.size(F.filter(F.slice(m["content_items"], 1, k + 1), lambda x: x["type"] == kind))
        number = F.when(ids, F.concat(F.lit(f"{name} "), nth.cast("string"), F.lit(": "))).otherwise("")
        return F.concat(number, F.lit(VISION_START + pad + VISION_END))

    def item(i: Column, k: Column) -> Column:
        return F.when(i["type"] == "image", marker("image", "Picture", IMAGE_PAD, i, k)).when(i["type"] == "video", marker("video", "Video", VIDEO_PAD, i, k)).otherwise(_text(i["text"]))

    return F.coalesce(m["content_text"], F.array_join(F.transform(m["content_items"], item), ""), F.lit(""))


def _role(messages: Column, at: Column) -> Column:
    """Role of the message at that place; empty beyond either end."""
    return F.coalesce(F.get(messages, at)["role"], F.lit(""))


def tool_lines(tools: Column) -> Column:
    """One JSON text a line, each after a line feed."""
    return F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")


_CALLS = "array<struct<id:string,name:string,arguments_json:string>>"


def _calls(m: Column) -> Column:
    return F.coalesce(m["tool_calls"], F.array().cast(_CALLS))


def json_parts(messages: Column, options: Column) -> Column:
    """Normalised JSON of a request's tools, and by message and call: arguments, and parameters. Null for texts that don't parse.

    Arrow functions can't run inside a lambda, so the texts are strung into one and parsed by one function.
    """
    every = F.struct(F.coalesce(options["tools"], F.array().cast("array<string>")).alias("t"), F.transform(messages, lambda m: F.transform(_calls(m), lambda c: F.coalesce(c["arguments_json"], F.lit("")))).alias("c"))
    return _parsed(F.to_json(every))


_TEXTS = ArrayType(StringType())
_PARSED = StructType([StructField("tools", _TEXTS), StructField("kinds", _TEXTS), StructField("arguments", ArrayType(_TEXTS)), StructField("parameters", ArrayType(_TEXTS))])


@F.pandas_udf(_PARSED)
def _parsed(x: pd.Series) -> pd.DataFrame:
    out = []
    for v in x:
        found = json.loads(v)
        tools, calls = found.get("t", []), found.get("c", [])
        out.append({
            "tools": [or_none(dumps, t) for t in tools],
            "kinds": [or_none(kind_of, t) for t in tools],
            "arguments": [[or_none(strict_dumps, a) for a in m] for m in calls],
            "parameters": [[or_none(parameter_block, a) for a in m] for m in calls],
        })
    return pd.DataFrame(out, columns=["tools", "kinds", "arguments", "parameters"])


def render_vl(messages: Column, options: Column, made: Column) -> Column:
    """Prompt of the profile ``vl``. ``made``: its ``json_parts``."""
    ids = F.coalesce(options["add_vision_id"], F.lit(False))
    system = _role(messages, F.lit(0)) == "system"
    first = plain(F.get(messages, F.lit(0)))
    tools = F.coalesce(F.size(options["tools"]), F.lit(0)) > 0
    head = F.when(tools, F.concat(F.lit(BEGIN + "system\n"), F.when(system, F.concat(first, F.lit("\n\n"))).otherwise(""), F.lit(VL_TOOLS), tool_lines(made["tools"]), F.lit(VL_TOOLS_END))).when(
        system, F.concat(F.lit(BEGIN + "system\n"), first, F.lit(END))
    ).otherwise("")

    def call(m: Column, at: Column, c: Column, k: Column) -> Column:
        truthy = F.when(m["content_text"].isNotNull(), m["content_text"] != "").otherwise(F.coalesce(F.size(m["content_items"]), F.lit(0)) > 0)
        gap = F.when((k > 0) | truthy, "\n").otherwise("")
        return F.concat(gap, F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), F.get(F.get(made["arguments"], at), k), F.lit("}\n</tool_call>"))

    def one(m: Column, at: Column) -> Column:
        user = F.concat(F.lit(BEGIN + "user\n"), visual(messages, m, at, ids), F.lit(END))
        calls = F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c, k: call(m, at, c, k)), ""), F.lit(""))
        assistant = F.concat(F.lit(BEGIN + "assistant\n"), plain(m), calls, F.lit(END))
        opens = F.when(_role(messages, at - 1) != "tool", BEGIN + "user").otherwise("")
        closes = F.when(_role(messages, at + 1) != "tool", END).otherwise("")
        tool = F.concat(opens, F.lit("\n<tool_response>\n"), visual(messages, m, at, ids), F.lit("\n</tool_response>"), closes)
        return F.when(m["role"] == "user", user).when(m["role"] == "assistant", assistant).when(m["role"] == "tool", tool).otherwise("")

    prompt = F.when(F.coalesce(options["add_generation_prompt"], F.lit(False)), BEGIN + "assistant\n").otherwise("")
    return F.concat(head, F.array_join(F.transform(messages, one), ""), prompt)


def last_query_index(messages: Column, ids: Column) -> Column:
    """The last user message that isn't a wrapped tool response; null if there is none."""

    def asks(m: Column, at: Column) -> Column:
        text = trim(visual(messages, m, at, ids))
        return (m["role"] == "user") & ~(text.startswith("<tool_response>") & text.endswith("</tool_response>"))

    return F.array_max(F.transform(messages, lambda m, at: F.when(asks(m, at), at)))


def reasoning(m: Column, content: Column) -> tuple[Column, Column]:
    """Reasoning and the rest of an assistant's content: given apart, or between think marks."""
    inline = m["reasoning_content"].isNull() & content.contains("</think>")
    before = F.rtrim(F.substring_index(content, "</think>", 1), F.lit("\n"))
    inner = F.ltrim(F.substring_index(before, "<think>", -1), F.lit("\n"))
    rest = F.ltrim(F.substring_index(content, "</think>", -1), F.lit("\n"))
    return trim(F.when(inline, inner).otherwise(_text(m["reasoning_content"]))), F.when(inline, rest).otherwise(content)


def render_thinking(messages: Column, options: Column, made: Column) -> Column:
    """Prompt of the profile ``thinking``; null if no message asks anything or a call's arguments aren't an object."""
    ids = F.coalesce(options["add_vision_id"], F.lit(False))
    system = _role(messages, F.lit(0)) == "system"
    first = trim(plain(F.get(messages, F.lit(0))))
    tools = F.coalesce(F.size(options["tools"]), F.lit(0)) > 0
    head = F.when(tools, F.concat(F.lit(THINKING_TOOLS), tool_lines(made["tools"]), F.lit(THINKING_TOOLS_END), F.when(system & (first != ""), F.concat(F.lit("\n\n"), first)).otherwise(""), F.lit(END))).when(
        system, F.concat(F.lit(BEGIN + "system\n"), first, F.lit(END))
    ).otherwise("")
    last = last_query_index(messages, ids)

    def one(m: Column, at: Column) -> Column:
        content = trim(visual(messages, m, at, ids))
        thought, rest = reasoning(m, content)
        lead = F.when(trim(rest) == "", "<tool_call>\n").otherwise("\n\n<tool_call>\n")

        def call(c: Column, k: Column) -> Column:
            return F.concat(F.when(k == 0, lead).otherwise("\n<tool_call>\n"), F.lit("<function="), c["name"], F.lit(">\n"), F.get(F.get(made["parameters"], at), k), F.lit("</function>\n</tool_call>"))

        parts = F.transform(_calls(m), call)
        calls = F.aggregate(parts, F.lit(""), lambda a, x: F.concat(a, x))
        think = F.when(at > last, F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"))).otherwise("")
        assistant = F.concat(F.lit(BEGIN + "assistant\n"), think, rest, calls, F.lit(END))
        user = F.concat(F.lit(BEGIN + "user\n"), content, F.lit(END))
        opens = F.when((at > 0) & (_role(messages, at - 1) != "tool"), BEGIN + "user").otherwise("")
        closes = F.when(_role(messages, at + 1) != "tool", END).otherwise("")
        tool = F.concat(opens, F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), closes)
        return F.when(m["role"] == "user", user).when(m["role"] == "assistant", assistant).when(m["role"] == "tool", tool).otherwise("")

    think = F.when(options["enable_thinking"] == F.lit(False), "<think>\n\n</think>\n\n").otherwise("<think>\n")
    prompt = F.when(F.coalesce(options["add_generation_prompt"], F.lit(False)), F.concat(F.lit(BEGIN + "assistant\n"), think)).otherwise("")
    body = F.aggregate(F.transform(messages, one), F.lit(""), lambda a, x: F.concat(a, x))
    return F.when(last.isNotNull(), F.concat(head, body, prompt))


def render(profile: Column, messages: Column, options: Column, made: Column) -> Column:
    return F.when(profile == "thinking", render_thinking(messages, options, made)).otherwise(render_vl(messages, options, made))


def expand(rendered: Column, replacements: Column) -> Column:
    """The n-th image or video marker replaced by the n-th text; null unless there are as many."""
    pieces = F.split(rendered, r"<\|(?:image|video)_pad\|>", -1)
    return F.when(F.size(pieces) == F.size(replacements) + 1, F.array_join(F.zip_with(pieces, replacements, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), ""))


def markers(rendered: Column) -> Column:
    """Modality of every marker, in order."""
    return F.regexp_extract_all(rendered, F.lit(r"<\|(image|video)_pad\|>"), 1)


def image_replacement(placeholders: Column) -> Column:
    return F.repeat(F.lit(IMAGE_PAD), placeholders.cast("int"))


def video_replacement(seconds: Column, per_frame: Column) -> Column:
    """seconds: array of texts with one decimal place."""
    frame = F.concat(F.lit(VISION_START), F.repeat(F.lit(VIDEO_PAD), per_frame.cast("int")), F.lit(VISION_END))
    return F.array_join(F.transform(seconds, lambda s: F.concat(F.lit("<"), s, F.lit(" seconds>"), frame)), "")


def spans(rendered: Column, replacements: Column) -> Column:
    """Of each marker: its range in the rendered text and its replacement's in the expanded text, in code points and bytes (end exclusive)."""
    pieces = F.split(rendered, r"<\|(?:image|video)_pad\|>", -1)
    kinds = markers(rendered)
    width = len(IMAGE_PAD)

    def one(r: Column, k: Column) -> Column:
        before, olds = F.slice(pieces, 1, k + 1), F.slice(replacements, 1, k)

        def total(f) -> Column:
            return F.aggregate(before, F.lit(0), lambda n, p: n + f(p))

        at, at_bytes = total(F.char_length) + width * k, total(F.octet_length) + width * k
        to = total(F.char_length) + F.aggregate(olds, F.lit(0), lambda n, p: n + F.char_length(p))
        to_bytes = total(F.octet_length) + F.aggregate(olds, F.lit(0), lambda n, p: n + F.octet_length(p))

        def pair(a: Column, n) -> Column:
            return F.struct(a.alias("start"), (a + n).alias("end"))

        return F.struct(
            F.get(kinds, k).alias("modality"),
            pair(at, width).alias("rendered_cp"),
            pair(at_bytes, width).alias("rendered_bytes"),
            pair(to, F.char_length(r)).alias("expanded_cp"),
            pair(to_bytes, F.octet_length(r)).alias("expanded_bytes"),
        )

    return F.when(F.size(pieces) == F.size(replacements) + 1, F.transform(replacements, one))
