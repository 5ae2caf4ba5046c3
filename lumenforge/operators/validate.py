"""Checks on requests, as one nullable struct (stage, category, message) a request.

Within a stage all checks are predicates over the row; ``coalesce`` tells the first that fails. No shuffle, no Python but the
parsed JSON that ``functions.chat.json_parts`` has made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.geometry import bad_shape
from lumenforge.plans import errors
from lumenforge.plans.limits import LIMITS
from lumenforge.plans.profiles import PROFILES
from lumenforge.plans.schema import EXCLUDED, ITEM_TYPES, ROLES

ERROR = "struct<stage:int,category:string,message:string>"


def failure(bad: Column, stage: str, category: str, message: str) -> Column:
    """The error if ``bad`` holds, else null."""
    what = F.struct(F.lit(errors.STAGES.index(stage)).alias("stage"), F.lit(category).alias("category"), F.lit(message).alias("message"))
    return F.when(F.coalesce(bad, F.lit(False)), what)


def first(*failures: Column) -> Column:
    return F.coalesce(*failures, F.lit(None).cast(ERROR))


def _n(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def _some(array: Column, what) -> Column:
    return F.coalesce(F.exists(array, what), F.lit(False))


def refs(messages: Column, kind: str) -> Column:
    """Input numbers of the items of one type, in order, repeats included."""
    none = F.array().cast("array<int>")
    each = F.transform(messages, lambda m: F.coalesce(F.transform(F.filter(m["content_items"], lambda i: i["type"] == kind), lambda i: i["input_index"]), none))
    return F.coalesce(F.flatten(each), none)


def structure_error(messages: Column, images: Column, videos: Column, made: Column) -> Column:
    """Roles, content, references and tool calls. ``made``: the request's ``json_parts``."""

    def bad(what: Column, message: str) -> Column:
        return failure(what, "request_structure", "invalid_request", message)

    def visual(m: Column) -> Column:
        return _some(m["content_items"], lambda i: i["type"].isin("image", "video"))

    def unused(kind: str, inputs: Column) -> Column:
        every = F.when(_n(inputs) > 0, F.sequence(F.lit(0), _n(inputs) - 1))
        return F.size(F.array_except(every, refs(messages, kind))) > 0

    def outside(kind: str, inputs: Column) -> Column:
        return _some(refs(messages, kind), lambda i: i.isNull() | (i < 0) | (i >= _n(inputs)))

    return first(
        bad(_n(messages) == 0, "a request needs a message"),
        bad(_some(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*ROLES)), "unknown role"),
        bad(_some(F.slice(messages, 2, 1 << 30), lambda m: m["role"] == "system"), "a system message comes first and once"),
        bad(_some(messages, lambda m: m["content_text"].isNull() == m["content_items"].isNull()), "a message has a text or items"),
        bad(_some(messages, lambda m: F.size(m["content_items"]) == 0), "a list of items is empty"),
        bad(_some(messages, lambda m: _some(m["content_items"], lambda i: i["type"].isNull() | ~i["type"].isin(*ITEM_TYPES))), "unknown item type"),
        bad(_some(messages, lambda m: m["role"].isin("system", "assistant") & visual(m)), "images and videos belong to user and tool messages"),
        bad(outside("image", images) | outside("video", videos), "an item refers to no input"),
        bad(_some(messages, lambda m: (m["role"] != "assistant") & ((_n(m["tool_calls"]) > 0) | m["reasoning_content"].isNotNull())), "tool calls and reasoning belong to assistant messages"),
        bad(_some(messages, lambda m: _some(m["tool_calls"], lambda c: c["name"].isNull() | (c["name"] == ""))), "a tool call needs a name"),
        bad(_some(made["arguments"], lambda m: _some(m, lambda a: a.isNull())), "tool call arguments are no JSON"),
        bad(unused("image", images) | unused("video", videos), "an input is never referred to"),
    )


def option_error(messages: Column, options: Column, profile: Column, made: Column) -> Column:
    """Profile and options."""
    thinks = profile.isin(*(k for k, v in PROFILES.items() if v["thinking"]))
    known = profile.isin(*PROFILES)
    prompt = F.coalesce(options["add_generation_prompt"], F.lit(False))
    named = reduce(lambda rest, x: F.when(F.array_contains(options["excluded"], x), F.lit(x)).otherwise(rest), reversed(EXCLUDED), F.lit(None).cast("string"))
    stranger = F.size(F.array_except(options["excluded"], F.array(*map(F.lit, EXCLUDED)))) > 0
    return first(
        failure(profile.isNull() | ~known, "profile", "profile_mismatch", "unknown profile"),
        failure(named.isNotNull() | stranger, "options", "unsupported_option", "an option is not supported"),
        failure(options["enable_thinking"].isNotNull() & ~thinks, "options", "unsupported_option", "the profile can't think"),
        failure(options["enable_thinking"].isNotNull() & ~prompt, "options", "invalid_request", "enable_thinking needs a generation prompt"),
        failure(~thinks & _some(messages, lambda m: m["reasoning_content"].isNotNull()), "options", "unsupported_option", "the profile has no reasoning"),
        failure(_some(made["kinds"], lambda k: k.isNull() | (k != "object")), "options", "invalid_request", "a tool is no JSON object"),
    )


def counts(messages: Column, images: Column, videos: Column, options: Column) -> Column:
    """What the limits bound: messages, content_items, text_bytes, media, encoded_bytes, raw_frames."""

    def total(array: Column, f) -> Column:
        return F.aggregate(F.coalesce(F.transform(array, lambda x: F.coalesce(f(x), F.lit(0)).cast("long")), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)

    def size(x: Column) -> Column:
        return F.coalesce(F.octet_length(x), F.lit(0))

    text = total(messages, lambda m: size(m["content_text"]) + total(m["content_items"], lambda i: F.when(i["type"] == "text", size(i["text"]))) + size(m["reasoning_content"]) + total(m["tool_calls"], lambda c: size(c["id"]) + size(c["name"]) + size(c["arguments_json"])))
    return F.struct(
        _n(messages).cast("long").alias("messages"),
        total(messages, lambda m: _n(m["content_items"])).alias("content_items"),
        (text + total(options["tools"], size)).alias("text_bytes"),
        total(messages, lambda m: _n(F.filter(m["content_items"], lambda i: i["type"].isin("image", "video")))).alias("media"),
        total(images, lambda i: F.when(i["kind"] == "encoded", size(i["data"]))).alias("encoded_bytes"),
        total(videos, lambda v: _n(v["frames"])).alias("raw_frames"),
    )


def resource_error(counted: Column, messages: Column, images: Column, videos: Column, limits: dict[str, int] = LIMITS) -> Column:
    """Limits of one request, and sizes that an item states."""

    def over(what: Column, name: str) -> Column:
        return failure(what, "resource_preflight", "resource_limit", name)

    def rgb(r: Column) -> Column:
        return (r["height"].cast("long") * r["width"] > limits["decoded_pixels_per_image_or_frame"]) | (r["height"] > limits["decoded_edge_length"]) | (r["width"] > limits["decoded_edge_length"])

    def short(r: Column) -> Column:
        rows = (r["height"].cast("long") - 1) * F.coalesce(r["row_stride"], r["width"] * 3) + r["width"] * 3
        return bad_shape(r["height"], r["width"]) | (F.coalesce(r["row_stride"], r["width"] * 3) < r["width"] * 3) | (F.octet_length(r["data"]) < rows)

    prepared = limits["prepared_image_pixels_per_occurrence"]

    def wide(i: Column) -> Column:
        return (i["min_pixels"] > prepared) | (i["max_pixels"] > prepared) | (i["resized_height"] * i["resized_width"] > prepared)

    named = (("messages", "messages_per_request"), ("content_items", "content_items_per_request"), ("text_bytes", "text_bytes_per_request"), ("media", "media_per_request"))
    return first(
        *(over(counted[x] > limits[name], name) for x, name in named),
        over(_some(images, lambda i: (i["kind"] == "encoded") & (F.octet_length(i["data"]) > limits["encoded_bytes_per_item"])), "encoded_bytes_per_item"),
        over(_some(images, lambda i: (i["kind"] == "rgb8") & rgb(i)), "decoded pixels"),
        over(_some(videos, lambda v: _n(v["frames"]) > limits["raw_frames_per_video"]), "raw_frames_per_video"),
        over(_some(videos, lambda v: _some(v["frames"], rgb)), "decoded pixels"),
        over(_some(messages, lambda m: _some(m["content_items"], lambda i: (i["type"] == "image") & wide(i))), "prepared_image_pixels_per_occurrence"),
        failure(_some(images, lambda i: (i["kind"] == "rgb8") & short(i)), "geometry", "media_geometry", "an RGB view has no such rows"),
        failure(_some(videos, lambda v: (_n(v["frames"]) == 0) | _some(v["frames"], short)), "geometry", "media_geometry", "a clip has no such frames"),
    )


def placeholder_error(rendered: Column, kinds: Column) -> Column:
    """Markers in the prompt must be those of the media, in order: a text that spells one out is refused."""
    from lumenforge.functions.chat import markers

    return failure(markers(rendered) != kinds, "request_structure", "invalid_request", "the text has markers of its own")
