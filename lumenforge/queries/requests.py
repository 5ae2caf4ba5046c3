"""Requests with items, tools, media and faults, through the library's checks, templates and kernels."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenforge.functions import chat as C
from lumenforge.functions import media as M
from lumenforge.functions import tokens as T
from lumenforge.operators import validate
from lumenforge.plans import schema
from lumenforge.plans.engine import TAG, Engine, probe_image
from lumenforge.plans.profiles import fingerprint
from lumenforge.sources import requests as R
from lumenforge.sources.media import file_url_path, from_data_uri

from . import query, spread, table

_SIZES = ("min_pixels", "max_pixels", "resized_height", "resized_width", "total_pixels")


def _item(kind: Column | str, text: Column | None = None, index: Column | None = None) -> Column:
    """One content item of the schema."""
    none = F.lit(None)
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (none if text is None else text).cast("string").alias("text"), (none if index is None else index).cast("int").alias("input_index"),
        *(none.cast("long").alias(x) for x in _SIZES[:4]), none.cast("double").alias("sample_fps"), none.cast("double").alias("raw_fps"), none.cast("long").alias("total_pixels"),
    )


def _message(role: Column, text: Column | None = None, items: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        role.alias("role"), (none if text is None else text).cast("string").alias("content_text"), (none if items is None else items).cast(f"array<{schema.ITEM}>").alias("content_items"),
        (none if calls is None else calls).cast(f"array<{schema.TOOL_CALL}>").alias("tool_calls"), none.cast("string").alias("reasoning_content"),
    )


def _user(text: str = "hi", **more: object) -> dict:
    return {"role": "user", "content_text": text} | more


def _shown(*items: dict, role: str = "user") -> dict:
    return {"role": role, "content_items": list(items)}


_RGB = {"kind": "rgb8", "data": bytes(12), "height": 2, "width": 2}
_PICTURE, _CLIP = {"type": "image", "input_index": 0}, {"type": "video", "input_index": 0}
_CALL = {"id": "1", "name": "f", "arguments_json": "{}"}
_FRAME = {"data": bytes(12), "height": 2, "width": 2}
#: Messages, other parts of the request, and the category and message of its error.
CASES: list[tuple[list[dict], dict, str | None, str | None]] = [
    ([_user()], {}, None, None),
    ([], {}, "invalid_request", "a request needs a message"),
    ([_user(role=None)], {}, "invalid_request", "unknown role"),
    ([_user(role="system"), _user(role="system")], {}, "invalid_request", "a system message comes first and once"),
    ([{"role": "user"}], {}, "invalid_request", "a message has a text or items"),
    ([_user(content_items=[_PICTURE])], {"images": [_RGB]}, "invalid_request", "a message has a text or items"),
    ([_shown()], {}, "invalid_request", "a list of items is empty"),
    ([_shown({"type": "audio"})], {}, "invalid_request", "unknown item type"),
    ([_shown(_PICTURE, role="assistant")], {"images": [_RGB]}, "invalid_request", "images and videos belong to user and tool messages"),
    ([_shown(_PICTURE | {"input_index": 1})], {"images": [_RGB]}, "invalid_request", "an item refers to no input"),
    ([_shown(_PICTURE | {"input_index": -1})], {"images": [_RGB]}, "invalid_request", "an item refers to no input"),
    ([_user(tool_calls=[_CALL])], {}, "invalid_request", "tool calls and reasoning belong to assistant messages"),
    ([_user(reasoning_content="so")], {}, "invalid_request", "tool calls and reasoning belong to assistant messages"),
    ([_user(role="assistant", tool_calls=[_CALL | {"name": ""}])], {}, "invalid_request", "a tool call needs a name"),
    ([_user(role="assistant", tool_calls=[_CALL | {"arguments_json": "{"}])], {}, "invalid_request", "tool call arguments are no JSON"),
    ([_user()], {"images": [_RGB]}, "invalid_request", "an input is never referred to"),
    ([_user()], {"profile": "other"}, "profile_mismatch", "unknown profile"),
    ([_user()], {"options": {"excluded": ["truncation"]}}, "unsupported_option", "an option is not supported"),
    ([_user()], {"options": {"enable_thinking": True}}, "unsupported_option", "the profile can't think"),
    ([_user()], {"profile": "thinking", "options": {"enable_thinking": True}}, "invalid_request", "enable_thinking needs a generation prompt"),
    ([_user(role="assistant", reasoning_content="so")], {}, "unsupported_option", "the profile has no reasoning"),
    ([_user()], {"options": {"tools": ["[1]"]}}, "invalid_request", "a tool is no JSON object"),
    ([_user()] * 257, {}, "resource_limit", "messages_per_request"),
    ([_shown(*[{"type": "text", "text": "x"}] * 1025)], {}, "resource_limit", "content_items_per_request"),
    ([_shown(*[_PICTURE] * 65)], {"images": [_RGB]}, "resource_limit", "media_per_request"),
    ([_shown(_PICTURE)], {"images": [_RGB | {"height": 40000}]}, "resource_limit", "decoded pixels"),
    ([_shown(_PICTURE | {"min_pixels": 16777217})], {"images": [_RGB]}, "resource_limit", "prepared_image_pixels_per_occurrence"),
    ([_shown(_CLIP)], {"videos": [{"frames": [_FRAME] * 769}]}, "resource_limit", "raw_frames_per_video"),
    ([_shown(_PICTURE)], {"images": [_RGB | {"data": bytes(11)}]}, "media_geometry", "an RGB view has no such rows"),
    ([_shown(_PICTURE)], {"images": [_RGB | {"row_stride": 5}]}, "media_geometry", "an RGB view has no such rows"),
    ([_shown(_CLIP)], {"videos": [{"frames": []}]}, "media_geometry", "a clip has no such frames"),
    ([_user(role="system"), _shown(_PICTURE, {"type": "text", "text": "x"}, _CLIP), _user(role="assistant", tool_calls=[_CALL])], {"images": [_RGB], "videos": [{"frames": [_FRAME]}]}, None, None),
]


def _filled(kind: object, value: object) -> object:
    """The value with every field that its schema has."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(kind, StructType):
        return None if value is None else tuple(_filled(f.dataType, value.get(f.name)) for f in kind)
    return [_filled(kind.elementType, x) for x in value] if isinstance(kind, ArrayType) and value is not None else value


def _cases(spark: SparkSession) -> DataFrame:
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema.REQUEST)
    rows = [{"batch_id": k, "request_index": 0, "profile": "vl", "messages": m, "options": {}} | more for k, (m, more, *_) in enumerate(CASES)]
    return spark.createDataFrame([_filled(kind, r) for r in rows], kind)


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""
WITH t(k, category, message) AS (VALUES {", ".join(f"({k}, {_quoted(c)}, {_quoted(m)})" for k, (_, _, c, m) in enumerate(CASES))})
SELECT c_custkey, category, message FROM customer JOIN t ON c_custkey % {len(CASES)} = k""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1 to VAL-12, VAL-15, VAL-16, VAL-18, VAL-20, VAL-36, VAL-38, VAL-39, ERR-1: every customer sends one of the requests, most of them with one fault"""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(CASES)).alias("batch_id"))
    rows = rows.join(F.broadcast(_cases(spark)), "batch_id").withColumn("_made", C.json_parts(F.col("messages"), F.col("options")))
    m, i, v, o = (F.col(x) for x in ("messages", "images", "videos", "options"))
    found = validate.first(validate.structure_error(m, i, v, F.col("_made")), validate.option_error(m, o, F.col("profile"), F.col("_made")), validate.resource_error(validate.counts(m, i, v, o), m, i, v))
    return rows.select("c_custkey", found.alias("e")).select("c_custkey", "e.category", "e.message")


_MARK = "'<|vision_start|><|{0}_pad|><|vision_end|>'"


def _sql_visual(template: str) -> str:
    """Each turn's content: a picture before the text of every second conversation's user turns, a video after every fourth turn's."""
    return f"""
WITH t AS (SELECT *, role = 'user' AND conv_id % 2 = 0 AS pic, role = 'user' AND turn % 4 = 0 AS vid FROM conversations),
n AS (SELECT *, sum(pic::INT) OVER w AS p, sum(vid::INT) OVER w AS v FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, turn, role, CASE WHEN pic THEN CASE WHEN conv_id % 3 = 0 THEN 'Picture ' || p || ': ' ELSE '' END || {_MARK.format("image")} ELSE '' END || text
  || CASE WHEN vid THEN CASE WHEN conv_id % 3 = 0 THEN 'Video ' || v || ': ' ELSE '' END || {_MARK.format("video")} ELSE '' END AS content FROM n)
{template}"""


def _visual_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages and options of ``_sql_visual``'s conversations."""
    user = F.col("role") == "user"
    picture, clip = F.when(user & (F.col("conv_id") % 2 == 0), _item("image", index=F.lit(0))), F.when(user & (F.col("turn") % 4 == 0), _item("video", index=F.lit(0)))
    items = F.filter(F.array(picture, _item("text", F.col("text")), clip), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", _message(F.col("role"), items=items).alias("m")).alias("m"))
    rows = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["m"]).alias("messages"))
    given = R.options().withField("add_vision_id", F.col("conv_id") % 3 == 0)
    return rows.withColumn("options", given).withColumn("_made", C.json_parts(F.col("messages"), F.col("options")))


@query(_sql_visual("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM c GROUP BY conv_id"""))
def visual_prompts_vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1, TXT-9, TXT-10, WIN-6: items among texts, with and without numbers, by the template itself"""
    rows = _visual_turns(spark, sf_dir)
    return rows.select("conv_id", C.render_vl(F.col("messages"), F.col("options"), F.col("_made")).alias("rendered"))


@query(_sql_visual("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND turn > q THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END
  || trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS q FROM c) GROUP BY conv_id HAVING max(q) IS NOT NULL"""))
def visual_prompts_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-2, TXT-9, WIN-6, WIN-8"""
    rows = _visual_turns(spark, sf_dir)
    return rows.select("conv_id", C.render_thinking(F.col("messages"), F.col("options"), F.col("_made")).alias("rendered")).where("rendered is not null")


_TOOL = '{"type": "function", "function": {"name": "f"}}'


def _text_sql(x: str) -> str:
    """A text as an SQL expression."""
    return "(" + " || chr(10) || ".join(_quoted(p) for p in x.split("\n")) + ")"


@query(f"""
WITH e AS (SELECT event_id, event_type, props::JSON->>'k' AS k, CASE WHEN event_id % 2 = 0 THEN 'calling' ELSE '' END AS said FROM events),
u AS (SELECT *, '<|im_start|>user' || chr(10) || event_type || '<|im_end|>' || chr(10) AS asked, '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || k || chr(10) || '</tool_response><|im_end|>' || chr(10) AS answered FROM e)
SELECT event_id, {_text_sql(C.BEGIN + "system" + chr(10) + C.VL_TOOLS + chr(10) + _TOOL + C.VL_TOOLS_END)} || asked || '<|im_start|>assistant' || chr(10) || said || CASE WHEN said <> '' THEN chr(10) ELSE '' END
  || '<tool_call>' || chr(10) || '{{"name": "f", "arguments": {{"k": ' || k || '}}}}' || chr(10) || '</tool_call><|im_end|>' || chr(10) || answered || '<|im_start|>assistant' || chr(10) AS vl,
  {_text_sql(C.THINKING_TOOLS + chr(10) + _TOOL + C.THINKING_TOOLS_END + C.END)} || asked || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || said || CASE WHEN said <> '' THEN chr(10) || chr(10) ELSE '' END
  || '<tool_call>' || chr(10) || '<function=f>' || chr(10) || '<parameter=k>' || chr(10) || k || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call><|im_end|>' || chr(10) || answered || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS thinking FROM u""")
def tool_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3 to TXT-8, TXT-11: a tool, a call with or without words before it, and its response, in both templates"""
    call = F.struct(F.lit("1").alias("id"), F.lit("f").alias("name"), F.col("props").alias("arguments_json"))
    answer = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_id") % 2 == 0, "calling").otherwise("")
    messages = F.array(_message(F.lit("user"), F.col("event_type")), _message(F.lit("assistant"), said, calls=F.array(call)), _message(F.lit("tool"), answer))
    rows = table(spark, sf_dir, "events").select("event_id", messages.alias("messages"), R.options(True).withField("tools", F.array(F.lit(_TOOL))).alias("options"))
    rows = rows.withColumn("_made", C.json_parts(F.col("messages"), F.col("options")))
    m, o, made = F.col("messages"), F.col("options"), F.col("_made")
    return rows.select("event_id", C.render_vl(m, o, made).alias("vl"), C.render_thinking(m, o, made).alias("thinking"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1024 ELSE 4096 END::BIGINT AS min_pixels, CASE WHEN p_partkey % 3 = 0 THEN p_size * 65536 ELSE 1048576 END::BIGINT AS max_pixels, p_partkey % 5 = 0 AS prompt,
  CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand END AS source, p_partkey % 4 <> 3 AS one, CASE p_partkey % 3 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'BIGINT' ELSE 'STRING' END AS kind FROM part""")
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-3, SRC-11, VAL-14, VAL-34: shared options, budgets, aliases and kinds where a request has none or its own"""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    item = _item("image", index=F.lit(0)).withField("min_pixels", F.when(k % 2 == 0, size * 1024)).withField("max_pixels", F.when(k % 3 == 0, size * 65536))
    given = R.options().withField("add_generation_prompt", F.when(k % 5 == 0, True).cast("boolean"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.array(_message(F.lit("user"), items=F.array(item))).alias("messages"), given.alias("options"))
    rows = R.shared_options(R.image_defaults(rows, 4096, 1048576), add_generation_prompt=False)
    made = F.element_at(F.element_at("messages", 1)["content_items"], 1)
    alias = F.struct(F.when(k % 4 == 0, F.col("p_name")).alias("image"), F.struct(F.when(k % 4 != 0, F.col("p_brand")).alias("url")).alias("image_url"))
    both = R.one_alias(F.when(k % 2 == 0, F.lit(1)), F.when(k % 4 == 1, F.lit(1)))
    raw = F.when(k % 3 == 0, '{"fps": true}').when(k % 3 == 1, '{"fps": 2}').otherwise('{"fps": "2"}')
    return rows.select("p_partkey", made["min_pixels"].alias("min_pixels"), made["max_pixels"].alias("max_pixels"), F.col("options.add_generation_prompt").alias("prompt"), R.image_url(alias).alias("source"), both.alias("one"), R.strict_kind(raw, "$.fps").alias("kind"))


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), digits, "0")


def _little(x: Column, size: int) -> Column:
    """Hex of a number, little end first."""
    big = _hex(x, 2 * size)
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))))


@query("""
WITH s AS (SELECT p_partkey, p_partkey % 7 AS c, 1 + p_partkey * 37 % 3000 AS h, 1 + p_size * 101 % 3000 AS w FROM part)
SELECT p_partkey, CASE WHEN c = 5 THEN 'gif' WHEN c IN (0, 3, 6) THEN 'png' WHEN c IN (1, 4) THEN 'jpeg' ELSE 'webp' END AS format, CASE WHEN c < 3 THEN h END AS height, CASE WHEN c < 3 THEN w END AS width,
  CASE c WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'RGBA' ELSE 'RGB' END WHEN 1 THEN 'RGB' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'RGBA' ELSE 'RGB' END END AS mode,
  CASE WHEN c < 3 THEN NULL WHEN c = 5 THEN 'unsupported_media' ELSE 'media_decode' END AS error FROM s""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-2, IMG-4, IMG-5, IMG-6, IMG-22, VAL-37: made PNG, JPEG and WebP headers; one with a wrong check sum, one cut off, one of a format that isn't declared"""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (k % 7).alias("c"), (1 + k * 37 % 3000).alias("h"), (1 + F.col("p_size") * 101 % 3000).alias("w"))
    alpha = F.col("p_partkey") % 2 == 0
    head = F.concat(F.lit("49484452"), _hex(F.col("w"), 8), _hex(F.col("h"), 8), F.lit("08"), F.when(alpha, "06").otherwise("02"), F.lit("000000"))
    check = F.when(F.col("c") == 3, "00000000").otherwise(_hex(F.crc32(F.unhex(head)), 8))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), head, check, F.lit("0000000049454E44AE426082"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), _hex(F.col("h"), 4), _hex(F.col("w"), 4), F.lit("03012200021101031101FFD9"))
    webp = F.concat(F.lit("52494646160000005745425056503858" + "0A000000"), F.when(alpha, "10").otherwise("00"), F.lit("000000"), _little(F.col("w") - 1, 3), _little(F.col("h") - 1, 3))
    c = F.col("c")
    data = F.when(c.isin(0, 3, 6), png).when(c == 1, jpeg).when(c == 4, F.substring(jpeg, 1, 30)).when(c == 2, webp).otherwise("474946383961")
    name = F.when(c == 0, "PNG").when(c == 1, "Jpg").when(c == 2, "webp").when(c == 6, "jpeg")
    return rows.select("p_partkey", probe_image(F.unhex(data), M.format_name(name)).alias("p")).select("p_partkey", "p.*")


_FP = fingerprint("vl").encode().hex()
_LITTLE = "printf('%02x%02x%02x0000000000', {0} % 256, {0} // 256 % 256, {0} // 65536)"
_HEAD = f"'{(TAG + b'\0image\0').hex()}' || '{len(fingerprint('vl')):02x}00000000000000{_FP}'"


@query(f"""
WITH p AS (SELECT s_suppkey, 64 + s_suppkey * 7 % 100 AS h, 64 + s_suppkey * 13 % 100 AS w, s_suppkey % 2 AS r, s_suppkey // 2 % 2 AS g, s_suppkey // 4 % 2 AS b FROM supplier),
z AS (SELECT *, (h // 32 + CASE WHEN h % 32 > 16 OR (h % 32 = 16 AND h // 32 % 2 = 1) THEN 1 ELSE 0 END) * 2 AS gh, (w // 32 + CASE WHEN w % 32 > 16 OR (w % 32 = 16 AND w // 32 % 2 = 1) THEN 1 ELSE 0 END) * 2 AS gw FROM p)
SELECT s_suppkey // 8 AS batch_id, (s_suppkey % 8)::INT AS request_index, gh * gw * 6144 AS bytes,
  sha256(from_hex({_HEAD} || '7267623800' || {_LITTLE.format("h")} || {_LITTLE.format("w")} || {_LITTLE.format("(h * w * 3)")} || repeat(CASE r WHEN 1 THEN 'ff' ELSE '00' END || CASE g WHEN 1 THEN 'ff' ELSE '00' END || CASE b WHEN 1 THEN 'ff' ELSE '00' END, (h * w)::INT) || '00000000')) AS cache_key,
  sha256(from_hex(repeat(repeat(CASE r WHEN 1 THEN '0000803f' ELSE '000080bf' END, 512) || repeat(CASE g WHEN 1 THEN '0000803f' ELSE '000080bf' END, 512) || repeat(CASE b WHEN 1 THEN '0000803f' ELSE '000080bf' END, 512), (gh * gw)::INT))) AS digest FROM z""")
def solid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, SRC-14, IMG-11, IMG-15 to IMG-20: pictures of one colour through the whole engine, to the bit, with their cache keys"""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (64 + k * 7 % 100).cast("int").alias("h"), (64 + k * 13 % 100).cast("int").alias("w"))
    rows = spread(rows, "s_suppkey")  # before pictures are made
    color = F.concat(*(F.when(F.floor(k / 2**i) % 2 == 1, "ff").otherwise("00") for i in range(3)))
    data = F.unhex(F.repeat(color, F.col("h") * F.col("w")))
    image = F.struct(F.lit("rgb8").alias("kind"), data.alias("data"), F.lit(None).cast("string").alias("format"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(None).cast("int").alias("row_stride"))
    rows = rows.select(
        F.floor(k / 8).alias("batch_id"), (k % 8).cast("int").alias("request_index"), F.lit("vl").alias("profile"), F.array(_message(F.lit("user"), items=F.array(_item("image", index=F.lit(0))))).alias("messages"),
        F.array(image).alias("images"), F.lit(None).cast(f"array<{schema.VIDEO}>").alias("videos"), R.options(True).alias("options"),
    )
    out = Engine(spark).prepare_batch(rows).patches()
    return out.select("batch_id", "request_index", F.octet_length("patches").cast("long").alias("bytes"), "cache_key", F.sha2("patches", 256).alias("digest"))


TOKENIZER = os.environ.get("LUMENFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-21, TXT-22, TXT-29, TXT-30, WIN-9, VAL-29: texts to tokens and back; starts rise from 0, and end inside the text"""
    sha = T.file_hash(TOKENIZER)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokenizer(TOKENIZER, sha)(F.col("text")).alias("t"))
    decoded = T.decoder(TOKENIZER)(F.col("t.ids"))
    steps = F.zip_with(F.slice("t.starts", 2, 1 << 30), F.slice("t.starts", 1, F.greatest(F.size("t.starts") - 1, F.lit(0))), lambda b, a: b - a)
    rising = F.forall(steps, lambda d: d > 0) & (F.coalesce(F.get("t.starts", F.lit(0)), F.lit(0)) == 0)
    inside = F.coalesce(F.element_at("t.starts", -1) < F.octet_length(decoded), F.lit(True))
    return rows.select("conv_id", "turn", decoded.alias("decoded"), (rising & inside).alias("placed"), F.col("t.error").alias("error"))


if os.path.exists(TOKENIZER):  # its path is a parameter; without the file there is no such query
    query("SELECT conv_id, turn, nfc_normalize(text) AS decoded, true AS placed, NULL::VARCHAR AS error FROM conversations")(token_round_trip)


@F.pandas_udf(StringType())
def _encoded_key(data: pd.Series) -> pd.Series:
    mark = fingerprint("vl")
    return data.map(lambda x: M.image_key(mark, TAG + b"\0image\0", "encoded", bytes(x), "png", None, None, None, (None,) * 4))


@query(f"""SELECT doc_id, sha256(from_hex({_HEAD} || '656e636f64656400' || '01' || {_LITTLE.format("strlen(coalesce(text, ''))")} || hex(encode(coalesce(text, ''))) || '00000000')) AS key FROM documents""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-20: keys of encoded media, texts standing for their bytes"""
    return table(spark, sf_dir, "documents").select("doc_id", _encoded_key(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/a b/' || page_id || '.png' WHEN 1 THEN '//share/x/' || page_id WHEN 2 THEN '/é/' || page_id END AS path FROM pages""")
def file_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: escapes, hosts, and what is no file URL"""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("file:///srv/a%20b/"), n, F.lit(".png"))).when(k == 1, F.concat(F.lit("FILE://share/x/"), n)).when(k == 2, F.concat(F.lit("file://localhost/%C3%A9/"), n)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", file_url_path(url).alias("path"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN encode(event_type || ' ' || event_id) WHEN 1 THEN encode(event_type) END AS data,
  CASE WHEN event_id % 6 IN (2, 4) THEN 'unsupported_media' WHEN event_id % 6 IN (3, 5) THEN 'media_decode' END AS error FROM events""")
def data_uri_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: percent signs, white space within base64, and what is no image, no URI or no base64"""
    k, kind = F.col("event_id") % 6, F.col("event_type")
    base = F.base64(F.encode(kind, "UTF-8"))
    spaced = F.concat(F.lit("DATA:image/png;base64,"), F.substring(base, 1, 3), F.lit(" \n"), F.expr("substring(b, 4)"))
    uri = F.when(k == 0, F.concat(F.lit("data:image/png,"), kind, F.lit("%20"), F.col("event_id").cast("string"))).when(k == 1, spaced)
    uri = uri.when(k == 2, F.concat(F.lit("data:text/plain;base64,"), base)).when(k == 3, F.concat(F.lit("data:image/png;base64,"), base, F.lit("="))).when(k == 4, "data:image/png;base64").otherwise("data:image/png;base64,a*b=")
    rows = table(spark, sf_dir, "events").withColumn("b", base).withColumn("uri", uri)
    return rows.select("event_id", from_data_uri(F.col("uri")).alias("f")).select("event_id", "f.data", "f.error")


@query(f"""
WITH t(k, category) AS (VALUES {", ".join(f"({k}, {_quoted(c)})" for k, (_, _, c, _) in enumerate(CASES))})
SELECT s_suppkey AS batch_id, category FROM supplier JOIN t ON s_suppkey % {len(CASES)} = k WHERE category IS NOT NULL""")
def prepare_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, ERR-1 to ERR-4: the engine's error of each batch, where every supplier sends a batch of two requests, the second with a fault"""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(CASES)).alias("batch_id")).join(F.broadcast(_cases(spark)), "batch_id").drop("batch_id")
    bad = rows.select(F.col("s_suppkey").cast("long").alias("batch_id"), F.lit(1).alias("request_index"), "profile", "messages", "images", "videos", "options")
    good = rows.crossJoin(F.broadcast(_cases(spark).where("batch_id = 0").select(F.col("messages").alias("m"), F.col("options").alias("o"))))  # one row
    good = good.select(F.col("s_suppkey").cast("long").alias("batch_id"), F.lit(0).alias("request_index"), F.lit("vl").alias("profile"), F.col("m").alias("messages"), F.lit(None).cast(f"array<{schema.IMAGE}>").alias("images"), F.lit(None).cast(f"array<{schema.VIDEO}>").alias("videos"), F.col("o").alias("options"))
    return Engine(spark).prepare_batch(good.unionByName(bad)).errors.select("batch_id", "category")
