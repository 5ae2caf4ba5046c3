"""Templates, checks and expansion over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import chat as C
from lumenforge.functions.text import fmt_1dp, json_dumps, nfc
from lumenforge.operators import layout, validate
from lumenforge.plans.engine import Engine
from lumenforge.plans.limits import LIMITS
from lumenforge.sources import requests as R

from . import query, table


def _requests(spark: SparkSession, sf_dir: str, profile: str = "vl", whole: bool = True) -> DataFrame:
    return R.from_turns(table(spark, sf_dir, "conversations"), profile=profile, whole=whole)


def _rendered(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    rows = _requests(spark, sf_dir, profile)
    made = C.json_parts(F.col("messages"), F.col("options"))
    return rows.withColumn("_made", made).select("batch_id", "request_index", C.render(F.col("profile"), F.col("messages"), F.col("options"), F.col("_made")).alias("rendered"))


_IDS = "conv_id // 256 AS batch_id, (conv_id % 256)::INT AS request_index"


@query(f"""
SELECT {_IDS}, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS rendered
FROM conversations GROUP BY conv_id""")
def chat_render_vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1, AGG-1"""
    return _rendered(spark, sf_dir, "vl")


@query(f"""
WITH c AS (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS q, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations)
SELECT {_IDS}, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND turn > q THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || t || '<|im_end|>' || chr(10), '' ORDER BY turn)
  || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS rendered FROM c GROUP BY conv_id HAVING max(q) IS NOT NULL""")
def chat_render_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-2, TXT-5"""
    return _rendered(spark, sf_dir, "thinking").where("rendered is not null")


@query(f"""
WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 'system' WHEN conv_id % 11 = 5 AND turn = 0 THEN 'narrator' ELSE role END AS role FROM conversations)
SELECT {_IDS}, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) THEN 'unknown role' WHEN bool_or(role = 'system' AND turn > 0) THEN 'a system message comes first and once' END AS message,
  CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) OR bool_or(role = 'system' AND turn > 0) THEN 'invalid_request' END AS category FROM m GROUP BY conv_id""")
def chat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1 to VAL-15, over conversations with some roles spoilt"""
    turns = table(spark, sf_dir, "conversations")
    spoilt = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), "system").when((F.col("conv_id") % 11 == 5) & (F.col("turn") == 0), "narrator").otherwise(F.col("role"))
    rows = R.from_turns(turns.withColumn("role", spoilt), whole=True).withColumn("_made", C.json_parts(F.col("messages"), F.col("options")))
    rows = rows.withColumn("e", validate.structure_error(F.col("messages"), F.col("images"), F.col("videos"), F.col("_made")))
    return rows.select("batch_id", "request_index", "e.message", "e.category")


@query(f"SELECT {_IDS}, max(turn) FILTER (WHERE role = 'user')::INT AS last_query FROM conversations GROUP BY conv_id")
def last_query_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8"""
    return _requests(spark, sf_dir).select("batch_id", "request_index", C.last_query_index(F.col("messages"), F.lit(False)).alias("last_query"))


@query(f"SELECT {_IDS}, count(*) AS messages, 0::BIGINT AS content_items, sum(strlen(text))::BIGINT AS text_bytes, 0::BIGINT AS media FROM conversations GROUP BY conv_id")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-17"""
    rows = _requests(spark, sf_dir)
    counted = validate.counts(F.col("messages"), F.col("images"), F.col("videos"), F.col("options"))
    return rows.select("batch_id", "request_index", counted.alias("c")).select("batch_id", "request_index", "c.messages", "c.content_items", "c.text_bytes", "c.media")


@query("""
WITH r AS (SELECT conv_id // 32 AS batch_id, conv_id, sum(strlen(text)) AS bytes FROM conversations GROUP BY ALL)
SELECT batch_id, count(*) AS requests, sum(bytes)::BIGINT AS text_bytes, CASE WHEN count(*) > 30 THEN 'requests_per_batch' WHEN sum(bytes) > 30000 THEN 'encoded_bytes_per_batch' END AS limit_name FROM r GROUP BY batch_id""")
def preflight_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-16, AGG-5: batch limits, lowered, with text standing for encoded bytes"""
    rows = R.from_turns(table(spark, sf_dir, "conversations"), per_batch=32, whole=True)
    counted = validate.counts(F.col("messages"), F.col("images"), F.col("videos"), F.col("options"))
    sums = rows.select("batch_id", F.lit(0).alias("media"), counted["text_bytes"].alias("encoded_bytes"))
    found = layout.batch_errors(sums, LIMITS | {"requests_per_batch": 30, "encoded_bytes_per_batch": 30000})
    totals = sums.groupBy("batch_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("encoded_bytes").alias("text_bytes"))
    return totals.join(found.select("batch_id", F.col("message").alias("limit_name")), "batch_id", "left")


@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN 'tool' ELSE role END AS role, text FROM conversations),
e AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) FILTER (WHERE role = 'tool' AND before IS DISTINCT FROM 'tool') AS opened, count(*) FILTER (WHERE role = 'tool' AND after IS DISTINCT FROM 'tool') AS closed FROM e GROUP BY conv_id""")
def tool_run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, TXT-8: what the template opens and closes around runs of tool messages"""
    turns = table(spark, sf_dir, "conversations")
    rows = R.from_turns(turns.withColumn("role", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 1), "tool").otherwise(F.col("role"))), add_generation_prompt=False, whole=True)
    rows = rows.withColumn("_made", C.json_parts(F.col("messages"), F.col("options")))
    text = C.render_vl(F.col("messages"), F.col("options"), F.col("_made"))
    number = (F.col("batch_id") * 256 + F.col("request_index")).alias("conv_id")
    return rows.select(number, F.regexp_count(text, F.lit("<\\|im_start\\|>user\n<tool_response>")).cast("long").alias("opened"), F.regexp_count(text, F.lit("</tool_response><\\|im_end\\|>")).cast("long").alias("closed"))


_IMAGES = "(1 + l_partkey % 8) AS h, (1 + l_suppkey % 8) AS w"


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {_IMAGES} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, '<|vision_start|>' || repeat('<|image_pad|>', (h * w)::INT) || '<|vision_end|> and <|vision_start|>'
  || repeat('<' || printf('%.1f', l_quantity / 8) || ' seconds><|vision_start|>' || repeat('<|video_pad|>', w::INT) || '<|vision_end|>', 2) || '<|vision_end|>' AS expanded FROM i""")
def placeholder_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13 to TXT-16: a prompt with an image and a video of two temporal patches"""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (1 + F.col("l_partkey") % 8).alias("h"), (1 + F.col("l_suppkey") % 8).alias("w"))
    rows = rows.withColumn("_s", fmt_1dp(F.col("l_quantity") / 8))
    text = F.lit("<|vision_start|><|image_pad|><|vision_end|> and <|vision_start|><|video_pad|><|vision_end|>")
    made = F.array(C.image_replacement(F.col("h") * F.col("w")), C.video_replacement(F.array("_s", "_s"), F.col("w")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", C.expand(text, made).alias("expanded"))


@query("""
WITH m AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 5 = 0 THEN ' <|image_pad|>' WHEN conv_id % 5 = 1 THEN ' <|video_pad|>' ELSE '' END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN ['image'] WHEN conv_id % 5 = 1 THEN ['video'] ELSE [] END::VARCHAR[] AS kinds, conv_id % 5 < 2 AS literal FROM m""")
def literal_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-26, TXT-12: texts that spell out a marker"""
    turns = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " <|image_pad|>").when(F.col("conv_id") % 5 == 1, " <|video_pad|>").otherwise(""))
    e = validate.placeholder_error(text, F.array().cast("array<string>"))
    return turns.select("conv_id", "turn", C.markers(text).alias("kinds"), e.isNotNull().alias("literal"))


@query("SELECT event_id, printf('%.1f', value) AS whole, printf('%.1f', floor(value * 4) / 4 / 5) AS ties FROM events")
def fmt_one_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16"""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", fmt_1dp(F.col("value")).alias("whole"), fmt_1dp(F.floor(F.col("value") * 4) / 4 / 5).alias("ties"))


@query("""
SELECT event_id, '{"k": ' || (props::JSON->>'k') || '}' AS dumped, '<parameter=k>' || chr(10) || (props::JSON->>'k') || chr(10) || '</parameter>' || chr(10) AS parameters FROM events""")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17 to TXT-20"""
    from lumenforge.plans import schema

    rows = table(spark, sf_dir, "events").select("event_id", json_dumps("props").alias("dumped"), "props")
    call = F.struct(F.lit("").alias("id"), F.lit("f").alias("name"), F.col("props").alias("arguments_json"))
    message = F.struct(F.lit("assistant").alias("role"), F.array(call).alias("tool_calls"))
    rows = rows.withColumn("_made", C.json_parts(F.array(message), F.lit(None).cast(schema.OPTIONS)))
    return rows.select("event_id", "dumped", F.get(F.get("_made.parameters", F.lit(0)), F.lit(0)).alias("parameters"))


@query("SELECT doc_id, nfc_normalize(text) AS normal, strlen(nfc_normalize(text))::BIGINT AS bytes FROM documents")
def nfc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-23, TXT-24"""
    return table(spark, sf_dir, "documents").select("doc_id", nfc("text").alias("normal")).withColumn("bytes", F.octet_length("normal").cast("long"))


@query("""
WITH s AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'FILE://' || url WHEN 2 THEN 'data:image/png;base64,' || url WHEN 3 THEN '/srv/' || page_id || '.png' WHEN 4 THEN 'ftp://' || url ELSE upper(url) END AS source FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http' WHEN 1 THEN 'file' WHEN 2 THEN 'data' WHEN 3 THEN 'path' WHEN 4 THEN 'unsupported' ELSE 'http' END AS kind FROM s""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10"""
    k = F.col("page_id") % 6
    source = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("FILE://"), "url")).when(k == 2, F.concat(F.lit("data:image/png;base64,"), "url")).when(k == 3, F.concat(F.lit("/srv/"), F.col("page_id"), F.lit(".png"))).when(k == 4, F.concat(F.lit("ftp://"), "url")).otherwise(F.upper("url"))
    return table(spark, sf_dir, "pages").select("page_id", R.source_kind(source).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['extra'] ELSE [] END::VARCHAR[] AS unknown FROM events""")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-13, SET-3"""
    text = F.when(F.col("event_id") % 3 == 0, '{"role": "user", "extra": 1, "content": "x"}').otherwise('{"role": "user", "content": "x"}')
    return table(spark, sf_dir, "events").select("event_id", R.unknown_keys(text, "message").alias("unknown"))


@query(f"""
SELECT {_IDS}, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS expanded
FROM conversations GROUP BY conv_id""")
def prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: prompts of whole batches, all or nothing"""
    return Engine(spark).prepare_batch(_requests(spark, sf_dir, whole=False)).text.select("batch_id", "request_index", "expanded")
