"""Pixels and bytes: formulas that SQL has, and kernels that it hasn't."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import media as M
from lumenforge.functions import stats
from lumenforge.plans import schema
from lumenforge.plans.engine import Engine
from lumenforge.sources.media import from_data_uri
from lumenforge.sources.requests import options

from . import query, spread, table


@query("SELECT p_partkey, (p_partkey * 7 % 256 * (p_size * 5 % 256) + 255 * (255 - p_size * 5 % 256) + 127) // 255 AS channel FROM part")
def rgba_over_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-9"""
    return table(spark, sf_dir, "part").select("p_partkey", M.over_white(F.col("p_partkey") * 7 % 256, (F.col("p_size") * 5 % 256).cast("long")).alias("channel"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 AS c, p_partkey % 64 AS y, p_size % 96 AS x FROM part)
SELECT p_partkey, c, y, x, y // 32 * 12 + x // 32 * 4 + y % 32 // 16 * 2 + x % 32 // 16 AS patch_row, c * 512 + y % 16 * 16 + x % 16 AS first_column, ((x + y) * 2 - 127.5)::FLOAT / 127.5::FLOAT AS value FROM p""")
def normalize_patch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-15, IMG-16: where the pixels of a 64 by 96 picture go, looked up in the kernel's own output"""
    h, w = 64, 96
    where = np.arange(h * w).reshape(h, w)
    low, high = (M.patchify(np.repeat(v[None, :, :, None], 3, axis=3).astype(np.uint8)) * np.float32(127.5) + np.float32(127.5) for v in (where % 256, where // 256))
    place = np.rint(low + 256 * high).astype(int)
    found = np.zeros((3, h * w, 2), dtype=int)
    for c in range(3):
        part = place[:, c * 512 : c * 512 + 256]
        r, k = np.indices(part.shape)
        found[c, part.ravel()] = np.stack([r.ravel(), k.ravel() + c * 512], axis=1)
    cells = spark.createDataFrame([(c, i // w, i % w, int(found[c, i, 0]), int(found[c, i, 1])) for c in range(3) for i in range(h * w)], "c long, y long, x int, patch_row long, first_column long")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("c"), (F.col("p_partkey") % 64).alias("y"), (F.col("p_size") % 96).alias("x"))
    value = ((F.col("x") + F.col("y")) * 2 - 127.5).cast("float") / F.lit(127.5).cast("float")
    return rows.join(F.broadcast(cells), ["c", "y", "x"]).select("p_partkey", "c", "y", "x", "patch_row", "first_column", value.cast("float").alias("value"))  # 18,432 cells


@query("""WITH s AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN from_hex('FFD8FFE000104A46') WHEN 1 THEN from_hex('89504E470D0A1A0A') WHEN 2 THEN from_hex('524946460000000057454250') WHEN 3 THEN from_hex('474946383961') WHEN 4 THEN from_hex('424D0000') ELSE encode(html) END AS content FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif' WHEN 4 THEN 'bmp' END AS format FROM s""")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-1"""
    samples = ["FFD8FFE000104A46", "89504E470D0A1A0A", "524946460000000057454250", "474946383961", "424D0000"]
    content = F.encode("html", "UTF-8")
    for i, x in enumerate(samples):
        content = F.when(F.col("page_id") % 6 == i, F.unhex(F.lit(x))).otherwise(content)
    return table(spark, sf_dir, "pages").select("page_id", M.sniff(content).alias("format"))


@query("""SELECT doc_id, encode(text) AS data, NULL::VARCHAR AS error FROM documents WHERE text IS NOT NULL""")
def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: documents as base64 data URIs and back"""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))
    return rows.select("doc_id", from_data_uri(uri).alias("f")).select("doc_id", "f.data", "f.error")


@query()
def png_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-3 to IMG-19: made pictures are encoded, probed, decoded, resized and cut into patches, and put together again"""
    rows = table(spark, sf_dir, "nation").select("n_nationkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x = M.synthetic(40 + 8 * k, 100 + 4 * k, k)
                data = M.encode_png(x, k % 3)
                _, h, w, mode, error = M.probe(data, "png")
                y = M.resize_image(M.to_rgb(M.decode_png(data)), 64, 96)
                back = M.unpatchify(M.patchify(y[None]), 1, 4, 6)[0]
                same = bool((M.normalise(y) == back).all() and (M.decode_png(data) == x).all())
                near = stats.ssim(M.resize_image(x, 64, 96)[:, :, 0], M.resize_frame(x, 64, 96)[:, :, 0])
                yield pa.RecordBatch.from_pylist([{"n_nationkey": k, "height": h, "width": w, "mode": mode, "error": error, "same": same, "similar": near > 0.99}], _KERNEL)

    return rows.mapInArrow(run, "n_nationkey int, height long, width long, mode string, error string, same boolean, similar boolean")


_KERNEL = pa.schema([("n_nationkey", pa.int32()), ("height", pa.int64()), ("width", pa.int64()), ("mode", pa.string()), ("error", pa.string()), ("same", pa.bool_()), ("similar", pa.bool_())])


def picture_requests(spark: SparkSession, sf_dir: str, per_batch: int = 8) -> DataFrame:
    """Requests with one RGB picture and one text each, from suppliers: sides of 64 to 463."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (64 + F.col("s_suppkey") * 7 % 400).cast("int").alias("h"), (64 + F.col("s_suppkey") * 13 % 400).cast("int").alias("w"))
    return pictured(rows, per_batch)


def pictured(rows: DataFrame, per_batch: int = 8) -> DataFrame:
    """Requests with a made picture of each row's size. rows: s_suppkey, h, w; spread over all cores before pictures are made."""
    rows = spread(rows, "s_suppkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["s_suppkey"]], pa.int64()), pa.array([r["h"]], pa.int32()), pa.array([r["w"]], pa.int32()), pa.array([M.synthetic(r["h"], r["w"], r["s_suppkey"]).tobytes()], pa.binary())], ["s_suppkey", "h", "w", "data"])

    made = rows.mapInArrow(run, "s_suppkey long, h int, w int, data binary")
    none = F.lit(None)
    item = F.struct(F.lit("image").alias("type"), none.cast("string").alias("text"), F.lit(0).alias("input_index"), *(none.cast("long").alias(x) for x in ("min_pixels", "max_pixels", "resized_height", "resized_width")), *(none.cast("double").alias(x) for x in ("sample_fps", "raw_fps")), none.cast("long").alias("total_pixels"))
    text = F.struct(F.lit("text").alias("type"), F.concat(F.lit("What is picture "), F.col("s_suppkey").cast("string"), F.lit("?")).alias("text"), none.cast("int").alias("input_index"), *(none.cast("long").alias(x) for x in ("min_pixels", "max_pixels", "resized_height", "resized_width")), *(none.cast("double").alias(x) for x in ("sample_fps", "raw_fps")), none.cast("long").alias("total_pixels"))
    message = F.struct(F.lit("user").alias("role"), none.cast("string").alias("content_text"), F.array(item, text).alias("content_items"), none.cast(f"array<{schema.TOOL_CALL}>").alias("tool_calls"), none.cast("string").alias("reasoning_content"))
    image = F.struct(F.lit("rgb8").alias("kind"), "data", none.cast("string").alias("format"), F.col("h").alias("height"), F.col("w").alias("width"), none.cast("int").alias("row_stride"))
    return made.select(F.floor(F.col("s_suppkey") / per_batch).alias("batch_id"), (F.col("s_suppkey") % per_batch).cast("int").alias("request_index"), F.lit("vl").alias("profile"), F.array(message).alias("messages"), F.array(image).alias("images"), none.cast(f"array<{schema.VIDEO}>").alias("videos"), options(True).alias("options"))


@query("""WITH p AS (SELECT s_suppkey, 64 + s_suppkey * 7 % 400 AS h, 64 + s_suppkey * 13 % 400 AS w FROM supplier),
r AS (SELECT *, (h // 32 + CASE WHEN h % 32 > 16 OR (h % 32 = 16 AND h // 32 % 2 = 1) THEN 1 ELSE 0 END) * 2 AS gh, (w // 32 + CASE WHEN w % 32 > 16 OR (w % 32 = 16 AND w // 32 % 2 = 1) THEN 1 ELSE 0 END) * 2 AS gw FROM p)
SELECT s_suppkey // 8 AS batch_id, (s_suppkey % 8)::INT AS request_index, 1::BIGINT AS grid_t, gh AS grid_h, gw AS grid_w, sum(gh * gw) OVER w::BIGINT - gh * gw AS pixel_start, sum(gh * gw) OVER w::BIGINT AS pixel_end FROM r WINDOW w AS (PARTITION BY s_suppkey // 8 ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING)""")
def prepare_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: layout of whole batches of pictures"""
    done = Engine(spark).prepare_batch(picture_requests(spark, sf_dir))
    return done.sidecar.select("batch_id", "request_index", "grid_t", "grid_h", "grid_w", "pixel_start", "pixel_end")


@query()
def prepare_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, IMG-11 to IMG-20: pixels of whole batches of pictures"""
    out = Engine(spark).prepare_batch(picture_requests(spark, sf_dir)).patches()
    return out.select("batch_id", "request_index", "cache_key", F.octet_length("patches").alias("bytes"), F.sha2("patches", 256).alias("digest"), "error")
