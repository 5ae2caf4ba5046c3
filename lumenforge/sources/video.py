"""Clips: which frames a sampled video keeps, and frames from arrays or an optional decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.geometry import clip_range, default_sample_fps, nframes_by_rate, nframes_explicit, sample_indices


def as_frames(x: np.ndarray) -> np.ndarray:
    """Frames (time, height, width, 3) in bytes from THWC or TCHW; whole floats of 0 to 255 are taken as bytes."""
    if x.ndim != 4 or (x.shape[3] != 3 and x.shape[1] != 3):
        raise ValueError("frames are THWC or TCHW with three channels")
    x = x if x.shape[3] == 3 else x.transpose(0, 2, 3, 1)
    if np.issubdtype(x.dtype, np.floating):
        if not (np.isfinite(x).all() and (x == np.round(x)).all() and x.min() >= 0 and x.max() <= 255):
            raise ValueError("float frames must be whole numbers of 0 to 255")
    elif x.dtype != np.uint8:
        raise ValueError("frames must be bytes")
    return np.ascontiguousarray(x.astype(np.uint8))


def sampling(total: Column, fps: Column, rate: Column | float = 2.0, nframes: Column | None = None, start_s: Column | None = None, end_s: Column | None = None, least: Column | int = 4, most: Column | None = None) -> dict[str, Column]:
    """Columns start, end, count, indices, sample_fps and error of a sampled clip. Indices go through Arrow, the rest doesn't."""
    cut = clip_range(total, fps, start_s, end_s)
    available = cut["end"] - cut["start"] + 1
    by_rate = nframes_by_rate(available, fps, rate, least, most)
    count = by_rate if nframes is None else F.when(nframes.isNull(), by_rate).otherwise(nframes_explicit(nframes, available))
    return {
        "start": cut["start"],
        "end": cut["end"],
        "count": count,
        "indices": sample_indices(cut["start"], cut["end"], count),
        "sample_fps": default_sample_fps(count, total, fps),
        "error": F.coalesce(cut["error"], F.when(count.isNull(), "media_geometry")),
    }


def backend(name: str = "auto") -> Callable[[bytes, list[int]], np.ndarray]:
    """A function of (file, frame numbers) to frames; only the sampled frames are converted. Needs PyAV."""
    if name not in ("auto", "pyav"):
        raise ValueError(f"unknown video backend {name}")
    import io

    import av

    def frames(data: bytes, wanted: list[int]) -> np.ndarray:
        with av.open(io.BytesIO(data)) as box:
            some = set(wanted)
            found = {i: f.to_ndarray(format="rgb24") for i, f in enumerate(box.decode(video=0)) if i in some}
        return np.stack([found[i] for i in wanted])

    return frames


def decode_frames(rows: DataFrame, read: Callable[[bytes, list[int]], np.ndarray]) -> DataFrame:
    """Frames of clips, a row each: id, nth, height, width, data. rows: id, data, indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for k, f in enumerate(as_frames(read(r["data"], r["indices"]))):
                    yield pa.RecordBatch.from_arrays([pa.array([r["id"]], pa.int64()), pa.array([k], pa.int32()), pa.array([f.shape[0]], pa.int32()), pa.array([f.shape[1]], pa.int32()), pa.array([f.tobytes()], pa.binary())], ["id", "nth", "height", "width", "data"])

    return rows.select(F.col("id").cast("long"), "data", "indices").mapInArrow(run, "id long, nth int, height int, width int, data binary")
