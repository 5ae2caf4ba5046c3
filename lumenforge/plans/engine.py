"""The engine: a batch of requests to model inputs, as relations.

Checks, prompts and plans are made row by row, beside the bytes of the media, and written without them in the
session's shared folder. Offsets, errors, padding and layouts shuffle those narrow tables only. Pixels are made row by
row again, of batches that have no error: the bytes of pictures and frames are never shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumenforge import scratch
from lumenforge.functions import chat, geometry, media
from lumenforge.functions.text import fmt_1dp_each
from lumenforge.functions.tokens import check_special, decoder, tokenizer
from lumenforge.operators import layout, validate
from lumenforge.shipping import ship

from . import errors, schema
from .limits import lowered
from .profiles import MERGE, PROFILES, fingerprint, profiles_df

TAG = b"lumenforge-v1"
_PROBED = StructType([StructField("format", StringType()), StructField("height", LongType()), StructField("width", LongType()), StructField("mode", StringType()), StructField("error", StringType())])


@F.pandas_udf(_PROBED)
def probe_image(data: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Header of each encoded image; all null where there are no bytes."""
    return pd.DataFrame([(None,) * 5 if d is None else media.probe(bytes(d), f) for d, f in zip(data, declared, strict=True)], columns=[f.name for f in _PROBED])


@lru_cache(maxsize=16)
def plan_column(app: str, limits: tuple[tuple[str, int], ...]) -> Column:
    """Plan of an occurrence, over the columns that ``Prepared`` gives it. Built once an application: it has thousands of nodes."""
    c, i = F.col, F.col("item")
    sizes = (i["min_pixels"], i["max_pixels"], i["resized_height"], i["resized_width"])
    h, w = c("source_height"), c("source_width")
    clip = geometry.video_plan(h, w, c("_frames"), *sizes, i["total_pixels"], c("_listed"), c("_ready"), dict(limits))
    return F.when(c("modality") == "image", geometry.image_plan(h, w, *sizes, dict(limits))).otherwise(clip)


@lru_cache(maxsize=16)
def metadata_column(app: str) -> Column:
    """Metadata of a clip, null for images."""
    c, i = F.col, F.col("item")
    facts = geometry.video_metadata(c("_frames"), c("_fps"), i["sample_fps"], i["raw_fps"], c("_frames_indices"), c("_timestamps"), c("_total_num_frames"), c("_listed"))
    return F.when(c("modality") == "video", facts)


@dataclass
class Prepared:
    """Relations of a prepared input; ``errors`` has one row for each failed batch, and no other result has rows of those."""

    engine: Engine
    requests: DataFrame
    padding_side: str

    @cached_property
    def checked(self) -> DataFrame:
        """Requests with their prompt, and the error and counts of their own columns. No shuffle."""
        made, m, o = F.col("_made"), F.col("messages"), F.col("options")
        rows = self.requests.withColumn("_made", chat.json_parts(F.coalesce(m, F.array().cast(f"array<{schema.MESSAGE}>")), o))
        rows = rows.withColumn("_counts", validate.counts(m, F.col("images"), F.col("videos"), o))
        found = validate.first(
            validate.structure_error(m, F.col("images"), F.col("videos"), made),
            validate.option_error(m, o, F.col("profile"), made),
            validate.resource_error(F.col("_counts"), m, F.col("images"), F.col("videos"), self.engine.limits),
        )
        rows = rows.withColumn("error", found)
        rendered = F.when(F.col("error").isNull(), chat.render(F.col("profile"), F.when(F.col("error").isNull(), m), o, made))
        rows = rows.withColumn("rendered", rendered)
        kinds = F.flatten(F.transform(m, lambda x: F.coalesce(F.transform(F.filter(x["content_items"], lambda i: i["type"] != "text"), lambda i: i["type"]), F.array().cast("array<string>"))))
        late = validate.first(
            validate.failure(F.col("error").isNull() & F.col("rendered").isNull(), "request_structure", "invalid_request", "no message asks anything, or a call's arguments are no object"),
            validate.placeholder_error(F.col("rendered"), kinds),
        )
        return rows.withColumn("error", F.coalesce("error", late)).drop("_made")

    @cached_property
    def planned_requests(self) -> DataFrame:
        """``checked`` without messages and media, written."""
        return scratch.table(self.checked.select("batch_id", "request_index", "profile", "rendered", "error", "_counts.media", "_counts.encoded_bytes"), "requests", "zstd")

    def _located(self) -> DataFrame:
        """Items of requests without errors beside their input, with its header and size. No shuffle."""
        rows = layout.occurrences(self.checked.where("error is null"), "profile")
        encoded = (F.col("modality") == "image") & (F.col("image.kind") == "encoded")
        declared = media.format_name(F.col("image.format"))
        probed = probe_image(F.when(encoded, F.col("image.data")), F.when(encoded, declared))
        rows = rows.withColumn("_probe", probed).withColumn("_unsupported", encoded & F.col("image.format").isNotNull() & declared.isNull())
        first = F.get("video.frames", F.lit(0))
        for side in ("height", "width"):
            given = F.when(encoded, F.col(f"_probe.{side}")).when(F.col("modality") == "image", F.col(f"image.{side}")).otherwise(first[side])
            rows = rows.withColumn(f"source_{side}", given.cast("long"))
        flags = {f"_{new}": F.coalesce(F.col(f"video.{x}"), F.lit(False)) for new, x in (("listed", "image_frames"), ("ready", "preprocessed"))}
        return rows.withColumns({**flags, "_frames": F.size("video.frames").cast("long")})

    def _planned(self, rows: DataFrame) -> DataFrame:
        app = self.engine.spark.sparkContext.applicationId
        return rows.withColumn("plan", plan_column(app, tuple(self.engine.limits.items())))

    @cached_property
    def occurrences(self) -> DataFrame:
        """One row per image or video item of requests without errors: its plan, or its error. Written, without bytes."""
        h, w = F.col("source_height"), F.col("source_width")
        uneven = (F.col("modality") == "video") & (~F.col("_listed") | F.col("_ready")) & F.exists("video.frames", lambda f: (f["height"] != h) | (f["width"] != w))
        rows = self._located().select(
            "batch_id", *layout.PLACE, "input_index", "modality", "profile", "item", "source_height", "source_width", "_probe", "_unsupported", "_frames", "_listed", "_ready", uneven.alias("_uneven"),
            *(F.col(f"video.{x}").alias(f"_{x}") for x in ("fps", "frames_indices", "timestamps", "total_num_frames")),
        )
        rows = self._planned(rows).withColumn("video_metadata", metadata_column(self.engine.spark.sparkContext.applicationId))
        rows = scratch.table(rows, "planned", "zstd")
        mode, limit = F.col("_probe.mode"), F.col("plan.error").isin("arithmetic_overflow", "resource_limit")
        error = F.coalesce(
            F.when(F.col("_unsupported"), "unsupported_media"),
            F.col("_probe.error"),
            F.when(limit, F.col("plan.error")),
            F.when(mode.isin("LA", "P", "animated") | mode.endswith(";16"), "unsupported_media"),
            F.when(F.col("_uneven"), "media_geometry"),
            F.col("plan.error"),
            F.col("video_metadata.error"),
        )
        flat = [F.col(f"plan.{x}").alias(x) for x in ("height", "width", "grid_t", "grid_h", "grid_w", "patch_rows", "placeholder_count", "pixel_values_bytes")]
        return rows.select("batch_id", *layout.PLACE, "input_index", "modality", "profile", "source_height", "source_width", F.col("_probe.format").alias("image_format"), mode.alias("image_mode"), *flat, "video_metadata", error.alias("media_error"))

    def _replacement(self) -> Column:
        seconds = fmt_1dp_each(F.when(F.col("media_error").isNull(), F.col("video_metadata.timestamps")))
        per_frame = F.floor(F.col("grid_h") * F.col("grid_w") / (MERGE * MERGE))
        return F.when(F.col("modality") == "image", chat.image_replacement(F.col("placeholder_count"))).otherwise(chat.video_replacement(seconds, per_frame))

    @cached_property
    def errors(self) -> DataFrame:
        """The error of each failed batch that is told first."""
        rows = self.planned_requests.where("error is not null").select("batch_id", "error.stage", "error.category", F.lit(None).cast("long").alias("occurrence_index"), "error.message")
        early = layout.batch_errors(self.planned_requests, self.engine.limits)
        order = layout.offsets(layout.without_failed(self.occurrences, early))  # so no more rows are ordered together than a batch may have
        late = order.where("media_error is not null").select("batch_id", F.lit(errors.STAGES.index("geometry")).alias("stage"), F.col("media_error").alias("category"), F.col("occurrence_index").cast("long"), F.lit("media").alias("message"))
        every = rows.unionByName(late).unionByName(early)
        if self.engine.tokenize is not None:
            spent = self.tokens.select("batch_id", F.size("token_ids").alias("token_count"), "media_bytes")
            every = every.unionByName(layout.token_errors(spent, self.engine.limits))
            wrong = self.tokens.where("token_error is not null").select("batch_id", F.lit(errors.STAGES.index("execution_invariant")).alias("stage"), F.col("token_error").alias("category"), F.lit(None).cast("long").alias("occurrence_index"), F.lit("tokens").alias("message"))
            every = every.unionByName(wrong)
        return scratch.table(layout.first_error(every), "errors")

    @cached_property
    def expanded(self) -> DataFrame:
        """Prompts before and after expansion, with the ranges of every replacement."""
        made = self.occurrences.where("media_error is null").withColumn("replacement", self._replacement())
        made = made.groupBy("batch_id", "request_index").agg(
            F.array_sort(F.collect_list(F.struct("message_index", "content_item_index", "replacement"))).alias("_r"),
            F.sum(F.col("pixel_values_bytes") + 24).alias("media_bytes"),
        )  # a request has at most media_per_request of them
        rows = self.planned_requests.where("error is null").select("batch_id", "request_index", "profile", "rendered").join(made, ["batch_id", "request_index"], "left")
        texts = F.coalesce(F.transform("_r", lambda r: r["replacement"]), F.array().cast("array<string>"))
        return rows.select("batch_id", "request_index", "profile", "rendered", chat.expand(F.col("rendered"), texts).alias("expanded"), chat.spans(F.col("rendered"), texts).alias("replacements"), F.coalesce("media_bytes", F.lit(0)).alias("media_bytes"))

    @cached_property
    def tokens(self) -> DataFrame:
        rows = self.expanded.withColumn("_t", self.engine.tokenize(F.col("expanded")))
        return scratch.table(rows, "tokens", "zstd").select("*", F.col("_t.ids").alias("token_ids"), F.col("_t.starts").alias("token_starts"), F.col("_t.error").alias("token_error")).drop("_t")

    @cached_property
    def text(self) -> DataFrame:
        """Prompts of batches without errors; with a tokenizer also ids, mask and modality ids, padded."""
        if self.engine.tokenize is None:
            return layout.without_failed(self.expanded, self.errors)
        rows = layout.without_failed(self.tokens, self.errors)
        ids = F.create_map(*(x for k, v in PROFILES.items() for x in (F.lit(k), F.struct(*(F.lit(v[n]).cast("long").alias(n) for n in ("pad", "image_pad", "video_pad"))))))[F.col("profile")]
        return layout.pad(rows, ids["pad"], self.padding_side, ids["image_pad"], ids["video_pad"])

    @cached_property
    def sidecar(self) -> DataFrame:
        """Occurrences of batches without errors: sizes, video metadata, dense indices and the ranges of their rows."""
        return layout.offsets(layout.without_failed(self.occurrences, self.errors).drop("media_error", "profile"))

    @cached_property
    def layouts(self) -> DataFrame:
        requests = layout.without_failed(self.planned_requests.select("batch_id", "request_index"), self.errors)
        return layout.request_ranges(requests, self.sidecar)

    @cached_property
    def text_ranges(self) -> DataFrame:
        """Where each request's elements stand in its batch's flat text arrays."""
        if self.engine.tokenize is None:
            raise errors.ProfileMismatchError("ranges of text need a tokenizer")
        return layout.text_ranges(self.text)

    @cached_property
    def token_spans(self) -> DataFrame:
        """Of each replacement, in order: its modality and its tokens (null where its edges fall inside tokens)."""
        if self.engine.tokenize is None:
            raise errors.ProfileMismatchError("spans of tokens need a tokenizer")
        rows = layout.without_failed(self.tokens, self.errors)
        rows = rows.select("batch_id", "request_index", "token_starts", F.octet_length("expanded").cast("long").alias("_total"), F.posexplode("replacements").alias("nth", "_r"))
        found = layout.token_ranges(F.col("token_starts"), F.col("_total"), F.col("_r.expanded_bytes.start"), F.col("_r.expanded_bytes.end"))
        return rows.select("batch_id", "request_index", "nth", "_r.modality", found.alias("tokens"))

    @property
    def capacities(self) -> DataFrame:
        if self.engine.tokenize is None:
            raise errors.ProfileMismatchError("capacities need a tokenizer")
        return layout.capacities(self.text.withColumn("token_count", F.size("input_ids")), self.sidecar)

    def patches(self) -> DataFrame:
        """Pixels: batch_id, request_index, message_index, content_item_index, modality, cache_key, patches (float32, little end first, 1536 a row), error.

        One row leaves a task at a time, so a task holds one picture or clip. Sizes are planned again beside the bytes.
        """
        rows = self._planned(self._located())
        rows = rows.join(self.errors.select("batch_id"), "batch_id", "left_anti")
        rows = rows.select("batch_id", *layout.PLACE, "modality", "profile", "item", "image", "video", F.col("_probe.format").alias("image_format"), F.col("_probe.mode").alias("image_mode"), "plan.height", "plan.width")
        marks = {k: fingerprint(k) for k in PROFILES}
        names = ["batch_id", *layout.PLACE, "modality"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    r = one.to_pylist()[0]
                    made = prepare_pixels(r, marks[r["profile"]])
                    columns = [pa.array([x], kind) for x, kind in zip(made, (pa.string(), pa.binary(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(one.column(x) for x in names), *columns], [*names, "cache_key", "patches", "error"])

        return rows.mapInArrow(run, "batch_id long, request_index int, message_index int, content_item_index int, modality string, cache_key string, patches binary, error string")

    def raise_first(self) -> Prepared:
        """Raises the error of the first failed batch, if any."""
        found = self.errors.orderBy("batch_id").limit(1).collect()
        if found:
            raise errors.raised(found[0]["category"], found[0]["message"], batch_id=found[0]["batch_id"], occurrence_index=found[0]["occurrence_index"])
        return self

    def write(self, path: str) -> None:
        """Text, media and layouts as Parquet; each is committed whole or not at all."""
        self.text.write.mode("overwrite").parquet(f"{path}/text")
        self.sidecar.write.mode("overwrite").parquet(f"{path}/media")
        self.layouts.write.mode("overwrite").parquet(f"{path}/layouts")
        self.patches().write.mode("overwrite").parquet(f"{path}/patches")

    def collect_batch(self, batch_id: int) -> dict[str, np.ndarray]:
        """The arrays of one batch (which its limits bound), keys of absent modalities left out."""
        out: dict[str, np.ndarray] = {}
        text = self.text.where(F.col("batch_id") == batch_id).orderBy("request_index")
        for name in ("input_ids", "attention_mask", "mm_token_type_ids"):
            out[name] = np.array([r[0] for r in text.select(name).collect()], dtype=np.int64)
        rows = self.sidecar.where(F.col("batch_id") == batch_id).orderBy("occurrence_index").select(*layout.PLACE, "modality", "grid_t", "grid_h", "grid_w").collect()
        pixels = {tuple(r[x] for x in layout.PLACE): bytes(r["patches"]) for r in self.patches().where(F.col("batch_id") == batch_id).where("error is null").collect()}
        for kind, values, grid in (("image", "pixel_values", "image_grid_thw"), ("video", "pixel_values_videos", "video_grid_thw")):
            some = [r for r in rows if r["modality"] == kind]
            if some:
                out[values] = np.concatenate([np.frombuffer(pixels[tuple(r[x] for x in layout.PLACE)], np.float32).reshape(-1, 1536) for r in some])
                out[grid] = np.array([[r["grid_t"], r["grid_h"], r["grid_w"]] for r in some], dtype=np.int64)
        return out


def prepare_pixels(r: dict, mark: str) -> tuple[str | None, bytes | None, str | None]:
    """Cache key, patches and error of one occurrence."""
    item, height, width = r["item"], r["height"], r["width"]
    sizes = tuple(item[x] for x in ("min_pixels", "max_pixels", "resized_height", "resized_width"))
    try:
        if r["modality"] == "image":
            x = r["image"]
            key = media.image_key(mark, TAG + b"\0image\0", x["kind"], bytes(x["data"]), r["image_format"], x["height"], x["width"], x["row_stride"], sizes)
            pixels = media.decode(bytes(x["data"]), r["image_format"], r["image_mode"]) if x["kind"] == "encoded" else media.unpack_rgb(bytes(x["data"]), x["height"], x["width"], x["row_stride"])
            return key, media.patchify(media.resize_image(pixels, height, width)[None]).astype("<f4").tobytes(), None
        v = r["video"]
        frames = [media.unpack_rgb(bytes(f["data"]), f["height"], f["width"], f["row_stride"]) for f in v["frames"]]
        wide = (item["min_pixels"], item["max_pixels"], item["total_pixels"], item["resized_height"], item["resized_width"])
        rates = (item["sample_fps"], item["raw_fps"], v["fps"], v["total_num_frames"])
        key = media.video_key(mark, TAG + b"\0video\0", frames, bool(v["image_frames"]), bool(v["preprocessed"]), wide, rates, v["timestamps"], v["frames_indices"])
        if v["image_frames"] and not v["preprocessed"]:
            frames = [media.resize_image(f, *first_size(f, sizes)) for f in frames]
        out = np.stack([media.resize_frame(f, height, width) for f in frames])
        return key, media.patchify(out).astype("<f4").tobytes(), None
    except media.BadMediaError as e:
        return None, None, str(e)


def first_size(frame: np.ndarray, sizes: tuple) -> tuple[int, int]:
    """Size of a listed frame's first resize, under twice the factor. The plan has checked it."""
    from fractions import Fraction
    from math import ceil, floor, sqrt

    lo, hi, rh, rw = sizes
    f = 2 * geometry.FACTOR
    explicit = rh is not None and rw is not None
    h, w = (rh, rw) if explicit else frame.shape[:2]
    lo, hi = (None, None) if explicit else (lo, hi)
    lo, hi = lo or geometry.MIN_CELLS * f * f, hi or geometry.MAX_CELLS * f * f
    hb, wb = (max(f, round(Fraction(x, f)) * f) for x in (h, w))
    if hb * wb > hi:
        b = sqrt(h * w / hi)
        return floor(h / b / f) * f, floor(w / b / f) * f
    if hb * wb < lo:
        b = sqrt(lo / (h * w))
        return ceil(h * b / f) * f, ceil(w * b / f) * f
    return hb, wb


class Engine:
    """Prepares requests under one set of limits. tokenizer_path: a ``tokenizer.json``; without it there are prompts and layouts only.

    ``special_tokens`` names a profile whose special texts must be single tokens with the profile's numbers.
    """

    def __init__(self, spark: SparkSession, limits: dict[str, int] | None = None, tokenizer_path: str | None = None, tokenizer_sha256: str | None = None, special_tokens: str | None = None) -> None:
        self.spark = ship(spark)
        self.limits = lowered(limits)
        self.tokenize = tokenizer(tokenizer_path, tokenizer_sha256) if tokenizer_path else None
        self.tokenizer_path = tokenizer_path
        if tokenizer_path and special_tokens:
            for one in PROFILES.values():
                if one["thinking"] == (special_tokens == "thinking"):
                    check_special(tokenizer_path, {chat.IMAGE_PAD: one["image_pad"], chat.VIDEO_PAD: one["video_pad"], chat.VISION_START: one["vision_start"], chat.VISION_END: one["vision_end"]})

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str, **more: object) -> Engine:
        """With the ``tokenizer.json`` of a folder."""
        return cls(spark, tokenizer_path=os.path.join(path, "tokenizer.json"), **more)

    def decode(self, ids: Column, skip_special: bool = False) -> Column:
        """Text of lists of token ids."""
        if self.tokenizer_path is None:
            raise errors.ProfileMismatchError("decoding needs a tokenizer")
        return decoder(self.tokenizer_path, skip_special)(ids)

    def profiles(self) -> DataFrame:
        return profiles_df(self.spark)

    def prepare_batch(self, requests: DataFrame, padding_side: str = "right") -> Prepared:
        """requests: see ``plans.schema``. All or nothing by batch."""
        if padding_side not in ("right", "left"):
            raise errors.UnsupportedOptionError("padding_side is right or left")
        return Prepared(self, requests, padding_side)

    def prepare(self, messages: list[dict], profile: str = "vl", images: list | None = None, videos: list | None = None, **options: object) -> Prepared:
        """One request as a batch of its own; fails with an exception."""
        row = {"batch_id": 0, "request_index": 0, "profile": profile, "messages": messages, "images": images, "videos": videos, "options": options}
        return self.prepare_batch(self.spark.createDataFrame([row], schema.REQUEST)).raise_first()
