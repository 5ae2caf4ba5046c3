"""What must hold of outputs: sums, order and shapes. Each check gives the batches that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.plans.profiles import MERGE


def _told(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select("batch_id", F.lit(rule).alias("rule")).distinct()


def order_errors(rows: DataFrame) -> DataFrame:
    """Batches whose occurrences are out of order: requests go back, indices or grid rows have gaps, or ranges don't meet.

    rows: batch_id, request_index, modality, occurrence_index, grid_row, pixel_start, pixel_end, patch_rows.
    """
    every = Window.partitionBy("batch_id").orderBy("occurrence_index")
    kind = Window.partitionBy("batch_id", "modality").orderBy("occurrence_index")
    rows = rows.select(
        "*", F.lag("request_index").over(every).alias("_request"), F.lag("occurrence_index").over(every).alias("_occurrence"),
        F.lag("grid_row").over(kind).alias("_grid"), F.lag("pixel_end").over(kind).alias("_end"),
    )
    rules = {
        "request order": F.col("request_index") < F.col("_request"),
        "occurrence index": F.col("occurrence_index") != F.coalesce(F.col("_occurrence") + 1, F.lit(0)),
        "grid row": F.col("grid_row") != F.coalesce(F.col("_grid") + 1, F.lit(0)),
        "pixel start": F.col("pixel_start") != F.coalesce("_end", F.lit(0)),
        "pixel range": F.col("pixel_end") - F.col("pixel_start") != F.col("patch_rows"),
    }
    bad = rows.select("batch_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))
    return bad.distinct()


def shape_errors(text: DataFrame, rows: DataFrame) -> DataFrame:
    """Batches whose arrays disagree: unequal widths, masks, grids that aren't positive and mergeable, pads that aren't the placeholders.

    text: batch_id, input_ids, attention_mask, mm_token_type_ids; rows: batch_id, modality, grid_t, grid_h, grid_w, patch_rows, placeholder_count.
    """
    n = F.size("input_ids")
    width = text.groupBy("batch_id").agg(F.min(n).alias("low"), F.max(n).alias("high")).where("low <> high")
    mask = text.where((n != F.size("attention_mask")) | (n != F.size("mm_token_type_ids")))
    grid = rows.where((F.col("grid_t") < 1) | (F.col("grid_h") % MERGE != 0) | (F.col("grid_w") % MERGE != 0) | (F.col("grid_h") < 1) | (F.col("grid_w") < 1) | (F.col("grid_t") * F.col("grid_h") * F.col("grid_w") != F.col("patch_rows")))

    def pads(kind: int) -> Column:
        return F.sum(F.size(F.filter("mm_token_type_ids", lambda i: i == kind)))

    seen = text.groupBy("batch_id").agg(pads(1).alias("image"), pads(2).alias("video"))
    planned = rows.groupBy("batch_id").agg(*(F.sum(F.when(F.col("modality") == k, F.col("placeholder_count")).otherwise(0)).alias(f"_{k}") for k in ("image", "video")))
    counts = seen.join(planned, "batch_id", "left").where((F.col("image") != F.coalesce("_image", F.lit(0))) | (F.col("video") != F.coalesce("_video", F.lit(0))))
    return reduce(DataFrame.unionByName, (_told(width, "width"), _told(mask, "mask"), _told(grid, "grid"), _told(counts, "placeholders")))


def prepared_errors(rows: DataFrame, fingerprint: str, least: int = 16, most: int = 65_536) -> DataFrame:
    """Prepared pictures from elsewhere that can't be taken: other contract, more than one frame, grids that don't merge, sizes, or bytes.

    rows: id, fingerprint, grid_t, grid_h, grid_w, patches (bytes). Returns id and rule, the first that fails.
    """
    patches = F.col("grid_t") * F.col("grid_h") * F.col("grid_w")
    rule = (
        F.when(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)), "fingerprint")
        .when(F.col("grid_t") != 1, "frames")
        .when((F.col("grid_h") % MERGE != 0) | (F.col("grid_w") % MERGE != 0), "merge")
        .when((patches < least) | (patches > most), "size")
        .when(F.octet_length("patches") != patches * 6144, "bytes")
    )
    return rows.select("id", rule.alias("rule")).where("rule is not null")
