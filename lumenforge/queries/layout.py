"""Order, offsets, padding, errors and joins over occurrences made from line items.

A batch is 20 orders, an order is a request, a line an occurrence: even lines are images, odd ones videos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.operators import invariants
from lumenforge.operators import layout as L
from lumenforge.plans import errors
from lumenforge.plans.limits import LIMITS
from lumenforge.sources import requests as R
from lumenforge.sources import sinks

from . import dealt, query, table

_O = """o AS (SELECT DISTINCT l_orderkey // 20 AS batch_id, (l_orderkey % 20)::INT AS request_index, l_linenumber AS message_index, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS content_item_index,
  CASE WHEN l_linenumber % 2 = 0 THEN 'image' ELSE 'video' END AS modality, 4 * (l_partkey % 64 + 1) AS patch_rows, l_partkey, l_suppkey FROM lineitem)"""
_PLACE = "request_index, message_index, content_item_index"


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.floor(F.col("l_orderkey") / 20).alias("batch_id"), (F.col("l_orderkey") % 20).cast("int").alias("request_index"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    nth = F.row_number().over(Window.partitionBy("batch_id", "request_index", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    return dealt(rows, lines, "batch_id").select(
        "batch_id", "request_index", F.col("l_linenumber").alias("message_index"), nth.cast("int").alias("content_item_index"),
        F.when(F.col("l_linenumber") % 2 == 0, "image").otherwise("video").alias("modality"), (4 * (F.col("l_partkey") % 64 + 1)).alias("patch_rows"), "l_partkey", "l_suppkey",
    )


@query(f"""WITH {_O} SELECT batch_id, {_PLACE}, modality, (row_number() OVER (PARTITION BY batch_id ORDER BY {_PLACE}) - 1)::INT AS occurrence_index, (row_number() OVER (PARTITION BY batch_id, modality ORDER BY {_PLACE}) - 1)::INT AS grid_row,
  sum(patch_rows) OVER w::BIGINT - patch_rows AS pixel_start, sum(patch_rows) OVER w::BIGINT AS pixel_end FROM o WINDOW w AS (PARTITION BY batch_id, modality ORDER BY {_PLACE} ROWS UNBOUNDED PRECEDING)""")
def occurrence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1, WIN-2, WIN-3"""
    rows = L.offsets(_occurrences(spark, sf_dir))
    return rows.select("batch_id", "request_index", "message_index", "content_item_index", "modality", "occurrence_index", "grid_row", "pixel_start", "pixel_end")


@query(f"""WITH {_O}, r AS (SELECT DISTINCT batch_id, request_index FROM o), k AS (SELECT *, unnest(['image', 'video']) AS modality FROM r),
s AS (SELECT k.*, count(o.modality) AS n, coalesce(sum(patch_rows), 0)::BIGINT AS patches FROM k LEFT JOIN o USING (batch_id, request_index, modality) GROUP BY ALL)
SELECT batch_id, request_index, modality, (sum(n) OVER w - n)::BIGINT AS grid_start, (sum(n) OVER w)::BIGINT AS grid_end, (sum(patches) OVER w - patches)::BIGINT AS pixel_start, (sum(patches) OVER w)::BIGINT AS pixel_end
FROM s WINDOW w AS (PARTITION BY batch_id, modality ORDER BY request_index ROWS UNBOUNDED PRECEDING)""")
def request_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4"""
    rows = _occurrences(spark, sf_dir)
    return L.request_ranges(rows.select("batch_id", "request_index").distinct(), rows)


@query("""
WITH t AS (SELECT conv_id // 8 AS batch_id, conv_id, turn, list_transform(range(strlen(text) % 40 + 1), lambda i: CASE WHEN (i + turn) % 9 = 0 THEN 7 WHEN (i + turn) % 13 = 0 THEN 8 ELSE 100 + i END) AS ids FROM conversations),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS gap FROM t)
SELECT conv_id, turn, ids || list_transform(range(gap), lambda i: 0::BIGINT) AS input_ids, list_transform(ids, lambda i: 1::BIGINT) || list_transform(range(gap), lambda i: 0::BIGINT) AS attention_mask,
  list_transform(ids, lambda i: CASE i WHEN 7 THEN 1 WHEN 8 THEN 2 ELSE 0 END::BIGINT) || list_transform(range(gap), lambda i: 0::BIGINT) AS mm_token_type_ids, 0 AS left_padding, gap::INT AS right_padding,
  list_transform(range(gap), lambda i: 0::BIGINT) || ids AS left_ids FROM w""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2, TXT-26 to TXT-28: made token ids, only to have lists of many lengths"""
    n = F.octet_length("text") % 40 + 1
    at = F.col("turn")
    ids = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when((i + at) % 9 == 0, F.lit(7).cast("long")).when((i + at) % 13 == 0, F.lit(8).cast("long")).otherwise(100 + i))
    rows = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 8).alias("batch_id"), "conv_id", "turn", ids.alias("token_ids"))
    pads = [F.lit(x).cast("long") for x in (0, 7, 8)]
    right = L.pad(rows, pads[0], "right", pads[1], pads[2])
    left = L.pad(right.drop("left_padding", "right_padding", "attention_mask", "mm_token_type_ids").withColumnRenamed("input_ids", "_r"), pads[0], "left", pads[1], pads[2])
    left = left.select("conv_id", "turn", F.col("input_ids").alias("left_ids"))
    return right.select("conv_id", "turn", "input_ids", "attention_mask", "mm_token_type_ids", "left_padding", "right_padding").join(left, ["conv_id", "turn"])


@query("""
WITH t AS (SELECT conv_id // 8 AS batch_id, conv_id, sum(strlen(text))::BIGINT AS token_count, sum(turn) * 100000 AS media_bytes FROM conversations GROUP BY ALL)
SELECT batch_id, CASE WHEN max(token_count) > 9000 THEN 'rendered_tokens_per_request' WHEN sum(token_count) > 20000 THEN 'rendered_tokens_per_batch' ELSE 'materialized_output_bytes_per_batch' END AS message FROM t
GROUP BY batch_id HAVING max(token_count) > 9000 OR sum(token_count) > 20000 OR 3 * count(*) * max(token_count) * 8 + sum(media_bytes) > 5000000""")
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-21, VAL-22: lowered limits, with bytes standing for tokens"""
    rows = table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 8).alias("batch_id"), "conv_id").agg(F.sum(F.octet_length("text")).alias("token_count"), (F.sum("turn") * 100000).alias("media_bytes"))
    lower = LIMITS | {"rendered_tokens_per_request": 9000, "rendered_tokens_per_batch": 20000, "materialized_output_bytes_per_batch": 5000000}
    return L.token_errors(rows, lower).select("batch_id", "message")


@query(f"""WITH {_O}, t AS (SELECT l_orderkey // 20 AS batch_id, l_orderkey, count(*) * 50 AS token_count FROM lineitem GROUP BY ALL),
a AS (SELECT batch_id, count(*) AS "rows", max(token_count) AS "columns" FROM t GROUP BY batch_id),
m AS (SELECT batch_id, sum(patch_rows) FILTER (WHERE modality = 'image')::BIGINT AS image_patches, sum(patch_rows) FILTER (WHERE modality = 'video')::BIGINT AS video_patches, count(*) FILTER (WHERE modality = 'image') AS images, count(*) FILTER (WHERE modality = 'video') AS videos FROM o GROUP BY batch_id)
SELECT a.*, image_patches, video_patches, images, videos, 3 * "rows" * "columns" * 8 + (coalesce(image_patches, 0) + coalesce(video_patches, 0)) * 6144 + (images + videos) * 24 AS bytes FROM a JOIN m USING (batch_id)""")
def capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, AGG-7, AGG-8"""
    text = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 20).alias("batch_id"), "l_orderkey").agg((F.count(F.lit(1)) * 50).alias("token_count"))
    return L.capacities(text, _occurrences(spark, sf_dir))


_F = """f AS (SELECT batch_id, CASE WHEN l_partkey % 10 = 0 THEN 4 ELSE 5 END AS stage, CASE l_suppkey % 4 WHEN 0 THEN 'media_geometry' WHEN 1 THEN 'resource_limit' WHEN 2 THEN 'media_decode' ELSE 'arithmetic_overflow' END AS category,
  row_number() OVER (PARTITION BY batch_id ORDER BY request_index, message_index, content_item_index) - 1 AS place FROM o WHERE l_partkey % 5 = 0 AND l_suppkey % 3 = 0)"""


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _occurrences(spark, sf_dir).where((F.col("l_partkey") % 5 == 0) & (F.col("l_suppkey") % 3 == 0))
    at = F.row_number().over(Window.partitionBy("batch_id").orderBy("request_index", "message_index", "content_item_index")) - 1
    s = F.col("l_suppkey") % 4
    kind = F.when(s == 0, "media_geometry").when(s == 1, "resource_limit").when(s == 2, "media_decode").otherwise("arithmetic_overflow")
    stage = F.when(F.col("l_partkey") % 10 == 0, errors.STAGES.index("decode")).otherwise(errors.STAGES.index("geometry"))
    return rows.select("batch_id", stage.alias("stage"), kind.alias("category"), at.cast("long").alias("occurrence_index"), F.lit("made").alias("message"))


@query(f"""WITH {_O}, {_F} SELECT batch_id, arg_min(category, (CASE category WHEN 'arithmetic_overflow' THEN 0 WHEN 'resource_limit' THEN 1 WHEN 'media_decode' THEN 2 ELSE 3 END, place)) AS category,
  arg_min(place, (CASE category WHEN 'arithmetic_overflow' THEN 0 WHEN 'resource_limit' THEN 1 WHEN 'media_decode' THEN 2 ELSE 3 END, place)) AS occurrence_index, 'made' AS message, count(*) AS failures FROM f GROUP BY batch_id""")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERR-1, ERR-2, AGG-6, TOPK-1"""
    return L.first_error(_failures(spark, sf_dir))


@query(f"WITH {_O}, {_F} SELECT batch_id, count(*) AS occurrences FROM o WHERE batch_id NOT IN (SELECT batch_id FROM f) GROUP BY batch_id")
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERR-3"""
    left = L.without_failed(_occurrences(spark, sf_dir), _failures(spark, sf_dir))
    return left.groupBy("batch_id").agg(F.count(F.lit(1)).alias("occurrences"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def unreferenced_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-2, VAL-7: customers as inputs, orders as uses"""
    uses = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return L.unreferenced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), uses, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def referenced_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-3"""
    uses = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return L.referenced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), uses, ["c_custkey"])


@query("""WITH u AS (SELECT DISTINCT l_orderkey, l_suppkey, min(l_linenumber * 1000000 + l_partkey) AS first_use FROM lineitem GROUP BY ALL),
s AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY first_use, l_suppkey) - 1)::INT AS slot FROM u) SELECT l_orderkey, l_suppkey, slot FROM s""")
def first_use_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-29: suppliers as shared buffers, numbered by first use in an order"""
    lines = table(spark, sf_dir, "lineitem")
    uses = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lines, "l_orderkey").select(F.lit(0).alias("batch_id"), F.col("l_orderkey").alias("request_index"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"), F.col("l_suppkey").alias("buffer"))
    order = F.struct("ordinal", "buffer")
    return R.first_use(uses.withColumn("ordinal", order)).select(F.col("request_index").alias("l_orderkey"), F.col("buffer").alias("l_suppkey"), "slot").distinct()


@query("""WITH s AS (SELECT l_orderkey // 20 AS batch_id, (l_orderkey % 20)::INT AS request_index, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)
SELECT batch_id, request_index, l_linenumber, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY batch_id, request_index ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS input_index FROM s""")
def inline_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12"""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.floor(F.col("l_orderkey") / 20).alias("batch_id"), (F.col("l_orderkey") % 20).cast("int").alias("request_index"), F.col("l_linenumber").alias("message_index"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("content_item_index"))
    out = R.inline_media(dealt(rows, lines, "batch_id"))
    return out.select("batch_id", "request_index", F.col("message_index").alias("l_linenumber"), "content_item_index.l_partkey", "content_item_index.l_suppkey", "input_index")


@query("""WITH d AS (SELECT doc_id // 50 AS batch_id, doc_id, strlen(text) AS length FROM documents WHERE text IS NOT NULL)
SELECT batch_id, doc_id, length, sum(length) OVER w::BIGINT AS running, length > 20000 OR sum(length) OVER w > 100000 AS over FROM d WINDOW w AS (PARTITION BY batch_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9, SRC-27: documents as inputs of a batch"""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 50).alias("batch_id"), "doc_id", F.octet_length("text").cast("long").alias("length"))
    return L.byte_budget(rows, 20000, 100000, "doc_id")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, list(event_id ORDER BY k) FILTER (WHERE k <= 5) AS kept, greatest(count(*) - 5, 0) AS dropped FROM n GROUP BY user_id""")
def bounded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK-3: the feature is the bound"""
    kept, left = L.bounded_events(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5)
    lists = kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("kept"))
    return lists.join(left, "user_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY sha256('7:1:' || p_partkey)) AS place FROM part")
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK-4: a stated, small table is permuted, so one window over it is meant"""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat(F.lit("7:1:"), F.col("p_partkey").cast("string")), 256).alias("_h"))
    return rows.select("p_partkey", F.row_number().over(Window.orderBy("_h")).cast("long").alias("place"))


@query("""WITH o AS (SELECT DISTINCT l_partkey % 100 AS source, l_linenumber AS option_key, l_orderkey FROM lineitem), u AS (SELECT DISTINCT source, option_key FROM o)
SELECT (SELECT count(*) FROM o) AS uses, (SELECT count(*) FROM u) AS decoded, (SELECT count(*) FROM o JOIN u USING (source, option_key)) AS joined""")
def decode_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6: equal sources with equal options are decoded once and joined back"""
    uses = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("source"), F.col("l_linenumber").alias("option_key"), "l_orderkey").distinct()
    once = L.decoded_once(uses, ["source", "option_key"])
    counts = [x.agg(F.count(F.lit(1)).alias(n)) for n, x in (("uses", uses), ("decoded", once), ("joined", uses.join(once, ["source", "option_key"])))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


_SPOILT = f"""{_O}, i AS (SELECT batch_id, {_PLACE}, modality, patch_rows, row_number() OVER (PARTITION BY batch_id ORDER BY {_PLACE}) - 1 AS occurrence_index, row_number() OVER (PARTITION BY batch_id, modality ORDER BY {_PLACE}) - 1 AS grid_row,
  sum(patch_rows) OVER (PARTITION BY batch_id, modality ORDER BY {_PLACE} ROWS UNBOUNDED PRECEDING)::BIGINT AS pixel_end FROM o),
s AS (SELECT batch_id, modality, CASE WHEN batch_id % 7 = 4 THEN -request_index ELSE request_index END AS request_index, occurrence_index + (batch_id % 7 = 5)::INT AS occurrence_index, CASE WHEN batch_id % 7 = 1 THEN 2 * grid_row ELSE grid_row END AS grid_row,
  pixel_end - patch_rows AS pixel_start, pixel_end + (batch_id % 7 = 2)::INT AS pixel_end, patch_rows + (batch_id % 7 = 3)::INT AS patch_rows FROM i),
x AS (SELECT *, lag(request_index) OVER e AS r0, lag(occurrence_index) OVER e AS o0, lag(grid_row) OVER k AS g0, lag(pixel_end) OVER k AS p0 FROM s WINDOW e AS (PARTITION BY batch_id ORDER BY occurrence_index), k AS (PARTITION BY batch_id, modality ORDER BY occurrence_index))"""


@query(f"""WITH {_SPOILT} SELECT DISTINCT batch_id, rule FROM (SELECT batch_id, unnest([CASE WHEN request_index < r0 THEN 'request order' END, CASE WHEN occurrence_index <> coalesce(o0 + 1, 0) THEN 'occurrence index' END,
  CASE WHEN grid_row <> coalesce(g0 + 1, 0) THEN 'grid row' END, CASE WHEN pixel_start <> coalesce(p0, 0) THEN 'pixel start' END, CASE WHEN pixel_end - pixel_start <> patch_rows THEN 'pixel range' END]) AS rule FROM x) WHERE rule IS NOT NULL""")
def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-28, WIN-11, HAR-8: layouts, most of them spoilt in one way"""
    k = F.col("batch_id") % 7
    rows = L.offsets(_occurrences(spark, sf_dir))
    more = {
        "request_index": F.when(k == 4, -F.col("request_index")).otherwise(F.col("request_index")),
        "occurrence_index": F.col("occurrence_index") + (k == 5).cast("int"),
        "grid_row": F.when(k == 1, 2 * F.col("grid_row")).otherwise(F.col("grid_row")),
        "pixel_end": F.col("pixel_end") + (k == 2).cast("int"),
        "patch_rows": F.col("patch_rows") + (k == 3).cast("int"),
    }
    return invariants.order_errors(rows.withColumns(more)).select("batch_id", "rule")


@query("""WITH o AS (SELECT o_orderkey // 20 AS batch_id, o_orderkey AS k FROM orders)
SELECT DISTINCT batch_id, 'width' AS rule FROM o GROUP BY batch_id HAVING bool_or(k % 37 = 0) AND NOT bool_and(k % 37 = 0) UNION ALL SELECT DISTINCT batch_id, 'mask' FROM o WHERE k % 41 = 0
UNION ALL SELECT DISTINCT batch_id, 'grid' FROM o WHERE k % 43 = 0 UNION ALL SELECT DISTINCT batch_id, 'placeholders' FROM o WHERE k % 47 = 0""")
def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-27, AGG-4, HAR-8: arrays of uneven width, masks of other length, grids that don't merge, pads that aren't the placeholders"""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 20).alias("batch_id"), "o_orderkey")
    wide = F.when(k % 37 == 0, 6).otherwise(5)
    ids = F.array_repeat(F.lit(3).cast("long"), wide)
    text = rows.select("batch_id", ids.alias("input_ids"), F.array_repeat(F.lit(1), wide + (k % 41 == 0).cast("int")).alias("attention_mask"), F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), wide - 1)).alias("mm_token_type_ids"))
    high = F.when(k % 43 == 0, 3).otherwise(2)
    made = rows.select("batch_id", F.lit("image").alias("modality"), F.lit(1).alias("grid_t"), high.alias("grid_h"), F.lit(2).alias("grid_w"), (2 * high).alias("patch_rows"), F.when(k % 47 == 0, 2).otherwise(1).alias("placeholder_count"))
    return invariants.shape_errors(text, made).select("batch_id", "rule")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS c FROM part) SELECT id, CASE c WHEN 0 THEN 'fingerprint' WHEN 1 THEN 'frames' WHEN 2 THEN 'merge' WHEN 3 THEN 'size' ELSE 'bytes' END AS rule FROM p WHERE c < 5""")
def prepared_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9: pictures that were prepared elsewhere, most of them with one fault"""
    c = F.col("p_partkey") % 6
    grid = {"grid_t": F.when(c == 1, 2).otherwise(1), "grid_h": F.when(c == 2, 3).when(c == 3, 2).otherwise(4), "grid_w": F.when(c == 3, 2).otherwise(4)}
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(c == 0, "other").otherwise("mine").alias("fingerprint"), *(v.alias(x) for x, v in grid.items()), c.alias("c"))
    size = F.col("grid_t") * F.col("grid_h") * F.col("grid_w") * 6144 - (F.col("c") == 4).cast("int")
    rows = rows.withColumn("patches", F.encode(F.repeat(F.lit("x"), size), "UTF-8"))
    return invariants.prepared_errors(rows, "mine")


@query(f"""WITH {_O} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY {_PLACE}) - 1 AS occurrence_index, modality, patch_rows AS "rows", sum(patch_rows) OVER w::BIGINT - patch_rows AS pixel_start, sum(patch_rows) OVER w::BIGINT AS pixel_end
FROM o WINDOW w AS (PARTITION BY batch_id, modality ORDER BY {_PLACE} ROWS UNBOUNDED PRECEDING)""")
def server_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8"""
    rows = L.offsets(_occurrences(spark, sf_dir)).withColumns({"grid_t": F.lit(1), "grid_h": F.lit(2), "grid_w": F.col("patch_rows") / 2})
    return sinks.flat_fields(rows).withColumn("rows", F.col("rows").cast("long"))


@query("""WITH t AS (SELECT conv_id // 8 AS batch_id, conv_id % 8 AS r, sum(turn) AS n FROM conversations GROUP BY ALL), w AS (SELECT *, max(n) OVER (PARTITION BY batch_id)::BIGINT + 1 AS width, row_number() OVER (PARTITION BY batch_id ORDER BY r) - 1 AS k FROM t)
SELECT batch_id, r::INT AS request_index, k * width AS element_start, (k + 1) * width AS element_end FROM w""")
def text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5"""
    rows = table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 8).alias("batch_id"), (F.col("conv_id") % 8).cast("int").alias("request_index")).agg(F.sum("turn").alias("n"))
    rows = rows.withColumn("token_ids", F.array_repeat(F.lit(1).cast("long"), (F.col("n") + 1).cast("int")))
    return L.text_ranges(L.pad(rows, F.lit(0).cast("long")))


@query("""WITH t AS (SELECT conv_id, turn, strlen(text) AS total, conv_id % 11 AS a, conv_id % 11 + turn * 3 AS b FROM conversations),
e AS (SELECT *, (total + 2) // 3 AS n, CASE WHEN a = total THEN (total + 2) // 3 WHEN a % 3 = 0 AND a < total THEN a // 3 END AS x, CASE WHEN b = total THEN (total + 2) // 3 WHEN b % 3 = 0 AND b < total THEN b // 3 END AS y FROM t)
SELECT conv_id, turn, CASE WHEN a < b AND x IS NOT NULL AND y IS NOT NULL THEN x END::INT AS first, CASE WHEN a < b AND x IS NOT NULL AND y IS NOT NULL THEN y END::INT AS "end" FROM e""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-25, JOIN-7: byte ranges over tokens of three bytes"""
    total = F.octet_length("text").cast("long")
    starts = F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / 3)), lambda i: i * 3)).otherwise(F.array().cast("array<long>"))
    a = F.col("conv_id") % 11
    found = L.token_ranges(starts, total, a, a + F.col("turn") * 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("s")).select("conv_id", "turn", "s.first", "s.end")
