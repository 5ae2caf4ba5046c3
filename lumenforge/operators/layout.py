"""Order, offsets, padding and batch limits over relations that carry ``batch_id`` and ordinals.

Everything here is partitioned by ``batch_id``: rows that are repartitioned by it once need no
further shuffle. A batch is bounded by its limits (256 requests, 256 media).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.plans import errors
from lumenforge.plans.limits import LIMITS

PLACE = ("request_index", "message_index", "content_item_index")


def occurrences(requests: DataFrame, *keep: str) -> DataFrame:
    """One row per image or video item: coordinates, modality, item options and its input. An inner lookup by position in the row, no join."""
    rows = requests.select("batch_id", "request_index", *keep, "images", "videos", F.posexplode("messages").alias("message_index", "_m"))
    rows = rows.select("*", F.posexplode("_m.content_items").alias("content_item_index", "item")).where(F.col("item.type").isin("image", "video"))
    video = F.col("item.type") == "video"
    at = F.col("item.input_index")
    return rows.select(
        "batch_id", *PLACE, at.alias("input_index"), F.col("item.type").alias("modality"), "item",
        F.when(~video, F.get("images", at)).alias("image"), F.when(video, F.get("videos", at)).alias("video"), *keep,
    )


def _running(*by: str) -> Window:
    return Window.partitionBy("batch_id", *by).orderBy(*PLACE)


def offsets(rows: DataFrame, patches: str = "patch_rows") -> DataFrame:
    """Adds occurrence_index, grid_row, pixel_start and pixel_end (end exclusive); the last three by modality."""
    upto = _running("modality").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(patches).over(upto)
    return (
        rows.withColumn("occurrence_index", F.row_number().over(_running()) - 1)
        .withColumn("grid_row", F.row_number().over(_running("modality")) - 1)
        .withColumn("pixel_end", end)
        .withColumn("pixel_start", F.col("pixel_end") - F.col(patches))
    )


def request_ranges(requests: DataFrame, rows: DataFrame, patches: str = "patch_rows") -> DataFrame:
    """Of every request and modality: the ranges of grid rows and pixel rows; an empty range stands where the next would begin."""
    kinds = requests.select("batch_id", "request_index", F.explode(F.array(F.lit("image"), F.lit("video"))).alias("modality"))
    sums = rows.groupBy("batch_id", "request_index", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum(patches).alias("rows"))
    both = kinds.join(sums, ["batch_id", "request_index", "modality"], "left").fillna(0, ["n", "rows"])
    upto = Window.partitionBy("batch_id", "modality").orderBy("request_index").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("grid_end", F.sum("n").over(upto)).withColumn("pixel_end", F.sum("rows").over(upto))
    return both.select("batch_id", "request_index", "modality", (F.col("grid_end") - F.col("n")).alias("grid_start"), "grid_end", (F.col("pixel_end") - F.col("rows")).alias("pixel_start"), "pixel_end")


def pad(rows: DataFrame, token: Column, side: str = "right", image: Column | None = None, video: Column | None = None) -> DataFrame:
    """Adds columns of equal width in a batch: input_ids, attention_mask, mm_token_type_ids, left_padding, right_padding. rows: batch_id, token_ids."""
    n = F.size("token_ids")
    gap = F.max(n).over(Window.partitionBy("batch_id")) - n
    zero = F.array_repeat(F.lit(0).cast("long"), F.col("_gap"))
    ones = F.array_repeat(F.lit(1).cast("long"), n)
    kinds = modality_ids(F.col("token_ids"), image, video)

    def joined(own: Column, fill: Column) -> Column:
        return F.concat(own, fill) if side == "right" else F.concat(fill, own)

    out = rows.withColumn("_gap", gap)
    out = out.withColumn("input_ids", joined(F.col("token_ids"), F.array_repeat(token, F.col("_gap"))))
    out = out.withColumn("attention_mask", joined(ones, zero)).withColumn("mm_token_type_ids", joined(kinds, zero))
    left, right = (F.lit(0), F.col("_gap")) if side == "right" else (F.col("_gap"), F.lit(0))
    return out.withColumn("left_padding", left).withColumn("right_padding", right).drop("_gap")


def text_ranges(text: DataFrame) -> DataFrame:
    """Of each request: where its row's elements stand in the batch's flat text arrays (end exclusive). text: batch_id, request_index, input_ids, padded."""
    row = F.row_number().over(Window.partitionBy("batch_id").orderBy("request_index")) - 1
    width = F.size("input_ids").cast("long")
    return text.select("batch_id", "request_index", (row * width).alias("element_start"), ((row + 1) * width).alias("element_end"))


def token_ranges(starts: Column, total: Column, begin: Column, end: Column) -> Column:
    """The tokens (first, end exclusive) that cover a range of bytes exactly; null if its edges fall inside tokens. starts: byte starts of all tokens; total: bytes of the text."""

    def edge(at: Column) -> Column:
        return F.when(at == total, F.size(starts)).otherwise(F.nullif(F.array_position(starts, at).cast("int"), F.lit(0)) - 1)

    first, last = edge(begin.cast("long")), edge(end.cast("long"))
    return F.when((begin < end) & first.isNotNull() & last.isNotNull(), F.struct(first.cast("int").alias("first"), last.cast("int").alias("end")))


def decoded_once(uses: DataFrame, keys: list[str]) -> DataFrame:
    """Each source and option set once, however often it is used; uses meet it again by ``keys``."""
    return uses.select(*keys).distinct()


def modality_ids(ids: Column, image: Column | None, video: Column | None) -> Column:
    """1 for image pads, 2 for video pads, 0 for all else."""

    def kind(i: Column) -> Column:
        out = F.lit(0).cast("long")
        if video is not None:
            out = F.when(i == video, F.lit(2).cast("long")).otherwise(out)
        return out if image is None else F.when(i == image, F.lit(1).cast("long")).otherwise(out)

    return F.transform(ids, kind)


def first_error(failures: DataFrame) -> DataFrame:
    """One error a batch. failures: batch_id, stage, category, occurrence_index, message.

    Earlier stages are told first, but for overflows and limits, which come before decoding and geometry; then by precedence, then by occurrence.
    """
    ranks = F.create_map(*(x for k, v in errors.PRECEDENCE.items() for x in (F.lit(k), F.lit(v))))
    rank = F.coalesce(ranks[F.col("category")], F.lit(max(errors.PRECEDENCE.values()) + 1))
    media = errors.STAGES.index("resource_preflight")
    stage = F.least(F.col("stage"), F.lit(media))
    key = F.struct(stage.alias("stage"), rank.alias("rank"), F.coalesce("occurrence_index", F.lit(-1)).alias("at"), F.col("category").alias("category"), F.col("message").alias("message"))
    best = failures.groupBy("batch_id").agg(F.min(key).alias("e"), F.count(F.lit(1)).alias("failures"))
    return best.select("batch_id", F.col("e.category").alias("category"), F.col("e.at").cast("long").alias("occurrence_index"), F.col("e.message").alias("message"), "failures")


def without_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """All or nothing: no row of a batch that has an error."""
    return rows.join(failed.select("batch_id").distinct(), "batch_id", "left_anti")


def batch_errors(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Limits over a batch. requests: batch_id, media, encoded_bytes. Partial sums, so no batch is gathered."""
    sums = requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("media").alias("media"), F.sum("encoded_bytes").alias("encoded"))
    name = (
        F.when(F.col("requests") > limits["requests_per_batch"], "requests_per_batch")
        .when(F.col("media") > limits["media_per_batch"], "media_per_batch")
        .when(F.col("encoded") > limits["encoded_bytes_per_batch"], "encoded_bytes_per_batch")
    )
    stage = F.lit(errors.STAGES.index("resource_preflight"))
    return sums.where(name.isNotNull()).select("batch_id", stage.alias("stage"), F.lit("resource_limit").alias("category"), F.lit(None).cast("long").alias("occurrence_index"), name.alias("message"))


def token_errors(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Limits on tokens and bytes of the arrays. rows: batch_id, token_count, media_bytes."""
    sums = rows.groupBy("batch_id").agg(F.max("token_count").alias("most"), F.sum("token_count").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("media_bytes").alias("media"))
    planned = 3 * F.col("n") * F.col("most") * 8 + F.col("media")
    name = (
        F.when(F.col("most") > limits["rendered_tokens_per_request"], "rendered_tokens_per_request")
        .when(F.col("total") > limits["rendered_tokens_per_batch"], "rendered_tokens_per_batch")
        .when(planned > limits["materialized_output_bytes_per_batch"], "materialized_output_bytes_per_batch")
    )
    stage = F.lit(errors.STAGES.index("resource_preflight"))
    return sums.where(name.isNotNull()).select("batch_id", stage.alias("stage"), F.lit("resource_limit").alias("category"), F.lit(None).cast("long").alias("occurrence_index"), name.alias("message"))


def capacities(text: DataFrame, rows: DataFrame) -> DataFrame:
    """Shapes and bytes of the output arrays of each batch; modalities without media have null."""
    t = text.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.max("token_count").alias("columns"))
    m = rows.groupBy("batch_id").agg(
        F.sum(F.when(F.col("modality") == "image", F.col("patch_rows"))).alias("image_patches"),
        F.sum(F.when(F.col("modality") == "video", F.col("patch_rows"))).alias("video_patches"),
        F.sum((F.col("modality") == "image").cast("long")).alias("images"),
        F.sum((F.col("modality") == "video").cast("long")).alias("videos"),
    )
    both = t.join(m, "batch_id", "left").fillna(0, ["images", "videos"])
    total = 3 * F.col("rows") * F.col("columns") * 8 + (F.coalesce("image_patches", F.lit(0)) + F.coalesce("video_patches", F.lit(0))) * 6144 + (F.col("images") + F.col("videos")) * 24
    return both.withColumn("bytes", total)


def unreferenced(inputs: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that no occurrence refers to."""
    return inputs.join(uses, keys, "left_anti")


def referenced(inputs: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    return inputs.join(uses, keys, "left_semi")


def byte_budget(rows: DataFrame, per_item: int, per_batch: int, order: str) -> DataFrame:
    """Adds ``over``: whether an item, or the batch up to it, exceeds the budget of bytes. rows: batch_id, length."""
    upto = Window.partitionBy("batch_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("length").over(upto)).withColumn("over", (F.col("length") > per_item) | (F.col("running") > per_batch))


def bounded_events(rows: DataFrame, group: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first events of each group, and how many were left out."""
    nth = Window.partitionBy(group).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= most).drop("_n")
    left = rows.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))
    return kept, left
