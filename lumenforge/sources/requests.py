"""Requests from files, tables and lists: defaults, aliases and inline media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenforge.plans import schema
from lumenforge.plans.limits import LIMITS

#: Keys that may stand in raw requests, by level.
KEYS = {
    "request": ("messages", "images", "videos", "options", "add_generation_prompt", "add_vision_id", "tools", "enable_thinking"),
    "message": ("role", "content", "tool_calls", "reasoning_content"),
    "text": ("type", "text"),
    "image": ("type", "image", "image_url", "input_index", "buffer_index", "min_pixels", "max_pixels", "resized_height", "resized_width", "options"),
    "video": ("type", "video", "input_index", "buffer_index", "min_pixels", "max_pixels", "total_pixels", "resized_height", "resized_width", "sample_fps", "raw_fps", "options"),
}


def read_requests(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Requests in the engine's schema, from Parquet or JSON lines."""
    return spark.read.schema(schema.REQUEST).format(kind).load(path)


def from_turns(turns: DataFrame, per_batch: int = 256, add_generation_prompt: bool = True, profile: str = "vl", whole: bool = False) -> DataFrame:
    """Requests of plain-text conversations. turns: conv_id, turn, role, text.

    Conversations with more turns than a request may have would be gathered in vain: their rows beyond the
    limit and one are left out before, so the request still fails by its limit and no task holds a huge one. ``whole``: every turn stays, for what doesn't apply that limit.
    """
    rows = turns
    if not whole:
        nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
        rows = turns.withColumn("_n", nth).where(F.col("_n") <= LIMITS["messages_per_request"] + 1)
    message = F.struct("turn", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda m: F.struct(
        m["role"].alias("role"), m["text"].alias("content_text"), F.lit(None).cast(f"array<{schema.ITEM}>").alias("content_items"),
        F.lit(None).cast(f"array<{schema.TOOL_CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("reasoning_content"),
    ))
    return grouped.select(
        (F.floor(F.col("conv_id") / per_batch)).cast("long").alias("batch_id"), (F.col("conv_id") % per_batch).cast("int").alias("request_index"), F.lit(profile).alias("profile"),
        messages.alias("messages"),
        F.lit(None).cast(f"array<{schema.IMAGE}>").alias("images"), F.lit(None).cast(f"array<{schema.VIDEO}>").alias("videos"), options(add_generation_prompt).alias("options"),
    )


def options(add_generation_prompt: bool = False, add_vision_id: bool = False, enable_thinking: bool | None = None) -> Column:
    return F.struct(
        F.lit(add_generation_prompt).alias("add_generation_prompt"), F.lit(add_vision_id).alias("add_vision_id"), F.lit(None).cast("array<string>").alias("tools"),
        F.lit(enable_thinking).cast("boolean").alias("enable_thinking"), F.lit(None).cast("array<string>").alias("excluded"),
    )


def shared_options(requests: DataFrame, **shared: object) -> DataFrame:
    """Options that hold where a request has none of its own."""
    fields = [f.name for f in requests.schema["options"].dataType]
    return requests.withColumn("options", F.struct(*(F.coalesce(F.col(f"options.{n}"), F.lit(shared[n])).alias(n) if n in shared else F.col(f"options.{n}").alias(n) for n in fields)))


def image_defaults(requests: DataFrame, min_pixels: int | None = None, max_pixels: int | None = None) -> DataFrame:
    """Budgets that hold for image items without their own."""
    given = {"min_pixels": min_pixels, "max_pixels": max_pixels}

    def item(i: Column) -> Column:
        for name, value in given.items():
            if value is not None:
                i = i.withField(name, F.when(i["type"] == "image", F.coalesce(i[name], F.lit(value).cast("long"))).otherwise(i[name]))
        return i

    return requests.withColumn("messages", F.transform("messages", lambda m: m.withField("content_items", F.transform(m["content_items"], item))))


def source_kind(source: Column) -> Column:
    """data, http, file, path or unsupported, by the scheme of a source."""
    low = F.lower(source)
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]+):", 1)
    return F.when(low.startswith("data:"), "data").when(scheme.isin("http", "https"), "http").when(scheme == "file", "file").when(scheme != "", "unsupported").when(source.isNotNull(), "path")


def image_url(item: Column) -> Column:
    """An image item's source: ``image``, or ``image_url`` as text or with its ``url``."""
    return F.coalesce(item["image"], item["image_url"]["url"])


def one_alias(*xs: Column) -> Column:
    """Whether exactly one of several names for the same thing is given."""
    return sum((x.isNotNull().cast("int") for x in xs), F.lit(0)) == 1


def unknown_keys(text: Column, level: str) -> Column:
    """Keys of a raw JSON object that its level doesn't have, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, KEYS[level]))))


def strict_kind(text: Column, path: str) -> Column:
    """Type of a raw JSON value, so that booleans don't pass for numbers: BOOLEAN, BIGINT, STRING and so on."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def inline_media(items: DataFrame) -> DataFrame:
    """Numbers inline sources in the order in which they are met: the n-th becomes input n of its request.

    items: batch_id, request_index, message_index, content_item_index, source. Adds input_index.
    """
    order = Window.partitionBy("batch_id", "request_index").orderBy("message_index", "content_item_index")
    return items.withColumn("input_index", F.row_number().over(order) - 1)


def first_use(uses: DataFrame) -> DataFrame:
    """Numbers shared buffers by request in the order of first use, then by buffer. uses: batch_id, request_index, ordinal, buffer (rows without a request or buffer are left out). Adds slot."""
    by = ["batch_id", "request_index"]
    rows = uses.dropna(subset=[*by, "buffer"]).withColumn("_first", F.min("ordinal").over(Window.partitionBy(*by, "buffer")))
    return rows.withColumn("slot", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first", "buffer")) - 1).drop("_first")
