"""Where results go beside Parquet: JSON metadata, an append-only log, and tensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metadata_json(text: DataFrame, sidecar: DataFrame, layouts: DataFrame) -> DataFrame:
    """One JSON text a batch: requests, media and layouts, each in order. A batch is bounded by its limits."""

    def listed(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        rest = [x for x in rows.columns if x not in ("batch_id", *order)]
        one = F.struct(*order, *rest)
        return rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(one)).alias(name))

    parts = [
        listed(text.select("batch_id", "request_index", "rendered", "expanded"), "requests", ["request_index"]),
        listed(sidecar.select("batch_id", "occurrence_index", "modality", "height", "width", "grid_t", "grid_h", "grid_w", "pixel_start", "pixel_end"), "media", ["occurrence_index"]),
        listed(layouts, "layouts", ["request_index", "modality"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "batch_id", "left")
    return out.select("batch_id", F.to_json(F.struct("requests", "media", "layouts")).alias("metadata"))


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def tensors(arrays: dict[str, np.ndarray], device: str | None = None) -> dict:
    """The arrays of ``Prepared.collect_batch`` as tensors that share their memory. Needs PyTorch."""
    import torch

    out = {k: torch.from_numpy(v) for k, v in arrays.items()}
    return {k: v.to(device) for k, v in out.items()} if device else out


def flat_fields(sidecar: DataFrame) -> DataFrame:
    """Where each picture's rows stand in the batch's flat pixel array, for servers that cut it by grid."""
    return sidecar.select("batch_id", "occurrence_index", "modality", (F.col("grid_t") * F.col("grid_h") * F.col("grid_w")).alias("rows"), "pixel_start", "pixel_end")
