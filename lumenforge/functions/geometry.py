"""Sizes of images and clips as column expressions: whole numbers and doubles only, no Python at run time.

Every plan is a struct with a nullable ``error`` (an error category, see ``plans.errors``); the
other fields are null where there is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lumenforge.plans.limits import LIMITS
from lumenforge.plans.profiles import FACTOR, IMAGE_MAX, IMAGE_MIN, MERGE, PATCH, PATCH_WIDTH, TEMPORAL

#: Default budgets in units of factor squared, the widest aspect ratio, and the largest unsigned 64-bit number.
MIN_CELLS, MAX_CELLS, ASPECT, U64 = 4, 16_384, 200, 18_446_744_073_709_551_615
VIDEO_MIN_CELLS, VIDEO_MAX_CELLS, VIDEO_TOTAL_CELLS = 128, 768, 128_000
Number = Column | int


def _col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: plans nest deeply, and a repeated operand would double at each level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def let_all(f: Callable[[Column], Column], **values: Column) -> Column:
    return let(F.struct(*(v.alias(k) for k, v in values.items())), f)


def _or(*xs: Column | None) -> Column:
    return F.coalesce(*(x for x in xs if x is not None))


def round_by_factor(n: Number, factor: Number) -> Column:
    """The nearest multiple of factor; halfway between two, the even one."""
    n, factor = _col(n), _col(factor)
    rest = n % factor
    whole = ((n - rest) / factor).cast("long")
    up = (2 * rest > factor) | ((2 * rest == factor) & (whole % 2 == 1))
    return (whole + up.cast("long")) * factor


def bad_shape(h: Column, w: Column) -> Column:
    """Whether a side is zero or the longer one exceeds ``ASPECT`` times the shorter one."""
    return (h <= 0) | (w <= 0) | (F.greatest(h, w) > ASPECT * F.least(h, w))


def smart_resize(h: Column, w: Column, factor: Number = FACTOR, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Sides that are multiples of factor, within a budget of pixels, at about the same aspect ratio: height, width, error."""
    f = _col(factor)
    lo, hi = _or(lo, f * f * MIN_CELLS), _or(hi, f * f * MAX_CELLS)

    def rounded(v: Column) -> Column:
        more = {k: v[k] for k in ("h", "w", "lo", "hi")}
        return let_all(fitted, **more, hb=F.greatest(f, round_by_factor(v["h"], f)), wb=F.greatest(f, round_by_factor(v["w"], f)))

    def fitted(v: Column) -> Column:
        area, most, least = v["h"].cast("double") * v["w"].cast("double"), v["hi"].cast("double"), v["lo"].cast("double")
        cells = f.cast("double")

        def side(x: Column, b: Column) -> Column:
            small = F.floor(x / F.sqrt(area / most) / cells).cast("long") * f
            large = F.ceil(x * F.sqrt(least / area) / cells).cast("long") * f
            return F.when(v["hb"] * v["wb"] > v["hi"], small).when(v["hb"] * v["wb"] < v["lo"], large).otherwise(b)

        wrong = (v["hi"] < v["lo"]) | (v["hi"] <= 0) | bad_shape(v["h"], v["w"])
        return let_all(checked, height=side(v["h"], v["hb"]), width=side(v["w"], v["wb"]), wrong=wrong)

    def checked(v: Column) -> Column:
        ok = ~v["wrong"] & (v["height"] > 0) & (v["width"] > 0)
        return F.struct(F.when(ok, v["height"]).alias("height"), F.when(ok, v["width"]).alias("width"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("media_geometry")).alias("error"))

    return let_all(rounded, h=h.cast("long"), w=w.cast("long"), lo=lo.cast("long"), hi=hi.cast("long"))


def explicit_error(rh: Column, rw: Column) -> Column:
    """A height without a width, or the other way round."""
    return F.when(rh.isNull() != rw.isNull(), "media_geometry")


def image_resource_error(h: Column, w: Column, lo: Column, hi: Column, rh: Column, rw: Column, limits: dict[str, int] = LIMITS) -> Column:
    """Overflow, then limits on pixels and sides, budgets and the explicit size, in that order."""
    edge, prepared = limits["decoded_edge_length"], limits["prepared_image_pixels_per_occurrence"]
    pixels = F.try_multiply(h, w)
    explicit = F.try_multiply(rh, rw)
    return (
        F.when(pixels.isNull(), "arithmetic_overflow")
        .when(pixels > limits["decoded_pixels_per_image_or_frame"], "resource_limit")
        .when((h > edge) | (w > edge), "resource_limit")
        .when((lo > prepared) | (hi > prepared), "resource_limit")
        .when(rh.isNotNull() & rw.isNotNull() & explicit.isNull(), "arithmetic_overflow")
        .when(explicit > prepared, "resource_limit")
    )


def grid_plan(h: Column, w: Column, t: Column, frames: Column, error: Column) -> Column:
    """Grid, patches, placeholders and bytes of a prepared size."""
    gh, gw = F.floor(h / PATCH).cast("long"), F.floor(w / PATCH).cast("long")
    rows = gh * gw * t
    fields = {"height": h, "width": w, "grid_t": t, "grid_h": gh, "grid_w": gw, "patch_rows": rows, "placeholder_count": F.floor(rows / (MERGE * MERGE)).cast("long"), "rgb_bytes": h * w * 3 * frames, "pixel_values_bytes": rows * (4 * PATCH_WIDTH)}
    return F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in fields.items()), error.alias("error"))


def image_plan(h: Column, w: Column, lo: Column | None = None, hi: Column | None = None, rh: Column | None = None, rw: Column | None = None, limits: dict[str, int] = LIMITS) -> Column:
    """Plan of one image. An explicit size is resized under the default budgets; item budgets are then only checked."""
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")

    def sized(v: Column) -> Column:
        explicit = v["rh"].isNotNull() & v["rw"].isNotNull()
        pick = [F.when(explicit, a).otherwise(b) for a, b in ((v["rh"], v["h"]), (v["rw"], v["w"]), (none, F.coalesce(v["lo"], F.lit(IMAGE_MIN))), (none, F.coalesce(v["hi"], F.lit(IMAGE_MAX))))]
        return let_all(judged, v=v, size=smart_resize(pick[0], pick[1], FACTOR, pick[2], pick[3]))

    def judged(x: Column) -> Column:
        v, size = x["v"], x["size"]
        large = size["height"] * size["width"] > limits["prepared_image_pixels_per_occurrence"]
        error = F.coalesce(
            image_resource_error(*(v[k] for k in ("h", "w", "lo", "hi", "rh", "rw")), limits),
            F.when(bad_shape(v["h"], v["w"]) | (v["hi"] < v["lo"]), "media_geometry"),
            explicit_error(v["rh"], v["rw"]),
            size["error"],
            F.when(large, "resource_limit"),
        )
        return let_all(lambda y: grid_plan(y["h"], y["w"], one, one, y["error"]), h=size["height"], w=size["width"], error=error)

    given = {"h": h, "w": w, "lo": lo, "hi": hi, "rh": rh, "rw": rw}
    return let_all(sized, **{k: none if x is None else x.cast("long") for k, x in given.items()})


def video_budget(frames: Column, lo: Column, hi: Column | None = None, total: Column | None = None, factor: int = FACTOR) -> Column:
    """The most pixels a frame may have: a share of the clip's total, not under the minimum and a bit, not over ``hi``. Null if the budgets contradict."""
    cell = float(factor * factor)
    none = F.lit(None).cast("long")

    def bounded(v: Column) -> Column:
        whole = F.coalesce(v["total"].cast("double"), F.lit(VIDEO_TOTAL_CELLS * cell * 0.9))
        share = F.greatest(F.least(F.lit(VIDEO_MAX_CELLS * cell), whole / v["frames"] * 2), F.floor(v["lo"] * 1.05).cast("double"))
        positive = (v["lo"] > 0) & (F.coalesce(v["hi"], F.lit(1)) > 0) & (F.coalesce(v["total"], F.lit(1)) > 0)
        return let_all(lambda x: F.when(x["ok"] & (x["most"] >= x["lo"]), x["most"].cast("long")), ok=positive, lo=v["lo"], most=F.least(v["hi"].cast("double"), share))

    return let_all(bounded, frames=frames.cast("double"), lo=lo, hi=none if hi is None else hi.cast("long"), total=none if total is None else total.cast("long"))


def padded(frames: Column) -> Column:
    """Frames, filled up to whole temporal patches."""
    return F.ceil(frames / TEMPORAL).cast("long") * TEMPORAL


def video_plan(h: Column, w: Column, frames: Column, lo: Column | None = None, hi: Column | None = None, rh: Column | None = None, rw: Column | None = None, total: Column | None = None, image_frames: Column | None = None, preprocessed: Column | None = None, limits: dict[str, int] = LIMITS) -> Column:
    """Plan of one clip of equal frames.

    Frames given as a list of images are first resized under twice the factor, and the padded number of frames shares
    the clip's pixels. Preprocessed frames keep their size, which must then fit the factor.
    """
    none, no = F.lit(None).cast("long"), F.lit(False)
    twice, edge = 2 * FACTOR, limits["decoded_edge_length"]

    def listed_first(v: Column) -> Column:
        """Lists of images are first resized one by one."""
        explicit = v["rh"].isNotNull() & v["rw"].isNotNull()
        lists = v["listed"] & ~v["ready"]
        pick = [F.when(explicit, a).otherwise(b) for a, b in ((v["rh"], v["h"]), (v["rw"], v["w"]), (none, v["lo"]), (none, v["hi"]))]
        first = smart_resize(pick[0], pick[1], twice, pick[2], pick[3])
        least = F.coalesce(v["lo"], F.lit(VIDEO_MIN_CELLS * FACTOR * FACTOR).cast("long"))
        most = video_budget(F.when(v["listed"], padded(v["frames"])).otherwise(v["frames"]), least, v["hi"], v["total"])
        return let_all(resized, v=v, explicit=explicit, lists=lists, first=first, least=least, most=most)

    def resized(x: Column) -> Column:
        v = x["v"]
        sh, sw = (F.when(x["lists"], x["first"][n]).otherwise(v[k]) for n, k in (("height", "h"), ("width", "w")))
        pick = [F.when(x["explicit"], a).otherwise(b) for a, b in ((v["rh"], sh), (v["rw"], sw), (none, x["least"]), (none, x["most"]))]
        return let_all(judged, x=x, sh=sh, sw=sw, size=smart_resize(pick[0], pick[1], FACTOR, pick[2], pick[3]))

    def judged(y: Column) -> Column:
        x, v = y["x"], y["x"]["v"]
        ready, size = v["ready"], y["size"]
        error = F.coalesce(
            F.when(v["frames"] < 1, "media_geometry").when(v["frames"] > limits["raw_frames_per_video"], "resource_limit"),
            F.when(v["h"] * v["w"] > limits["decoded_pixels_per_image_or_frame"], "resource_limit").when((v["h"] > edge) | (v["w"] > edge), "resource_limit"),
            F.when(bad_shape(v["h"], v["w"]), "media_geometry"),
            F.when(x["lists"], x["first"]["error"]),
            F.when(~ready & x["most"].isNull(), "media_geometry"),
            explicit_error(v["rh"], v["rw"]),
            F.when(ready & ((y["sh"] % FACTOR != 0) | (y["sw"] % FACTOR != 0)), "media_geometry"),
            F.when(~ready, size["error"]),
        )
        h, w = (F.when(ready, y[k]).otherwise(size[n]) for k, n in (("sh", "height"), ("sw", "width")))
        return let_all(lambda z: grid_plan(z["h"], z["w"], z["t"], z["frames"], z["error"]), h=h, w=w, t=F.floor(padded(v["frames"]) / TEMPORAL).cast("long"), frames=v["frames"], error=error)

    given = {"h": h, "w": w, "frames": frames, "lo": lo, "hi": hi, "rh": rh, "rw": rw, "total": total}
    flags = {"listed": image_frames, "ready": preprocessed}
    return let_all(listed_first, **{k: none if x is None else x.cast("long") for k, x in given.items()}, **{k: no if x is None else F.coalesce(x, no) for k, x in flags.items()})


def clip_range(total: Column, fps: Column, start_s: Column | None = None, end_s: Column | None = None) -> Column:
    """First and last frame (inclusive) of a clip cut by seconds; error if nothing is left."""
    last = total - 1

    def inside(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(x, total / fps))

    none = F.lit(None).cast("double")
    start_s, end_s = (none if x is None else x for x in (start_s, end_s))
    start = F.coalesce(F.ceil(inside(start_s) * fps).cast("long"), F.lit(0).cast("long"))
    end = F.coalesce(F.least(F.floor(inside(end_s) * fps).cast("long"), last), last)
    cut = start_s.isNotNull() | end_s.isNotNull()
    error = F.when((start > end) | ((start == end) & (total > 1) & cut), "media_geometry")
    return F.struct(F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), end).alias("end"), error.alias("error"))


def nframes_explicit(n: Column, available: Column) -> Column:
    """An even number of frames, half-way cases to a multiple of 4; null if it doesn't fit."""
    even = (F.bround(n / 2) * 2).cast("long")
    return F.when((even >= 2) & (even <= available), even)


def nframes_by_rate(available: Column, fps: Column, target: Column | float = 2.0, least: Column | int = 4, most: Column | None = None) -> Column:
    """Frames at a target rate, even, within bounds; a single frame stays one."""
    target = target if isinstance(target, Column) else F.lit(float(target))
    low = F.ceil(_col(least) / 2).cast("long") * 2
    high = F.floor(_or(most, F.least(F.lit(768).cast("long"), available)) / 2).cast("long") * 2
    wanted = F.least(F.greatest(available / fps * target, low.cast("double")), high.cast("double"), available.cast("double"))
    return F.when(available == 1, F.lit(1).cast("long")).when(high >= 2, F.floor(wanted / 2).cast("long") * 2)


@F.pandas_udf(ArrayType(LongType()))
def sample_indices(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Frames first, last, count -> evenly spaced frame numbers, in single precision from both ends, half to even."""
    for first, last, count in parts:
        out = []
        for a, b, n in zip(first, last, count, strict=True):
            if pd.isna(a) or pd.isna(b) or pd.isna(n) or n < 1:
                out.append(None)
                continue
            n = int(n)
            a32, b32 = np.float32(a), np.float32(b)
            step = np.float64(np.float32((b32 - a32) / np.float32(n - 1))) if n > 1 else np.float64(0)
            k = np.arange(n)
            low, high = np.float64(a32) + step * k, np.float64(b32) - step * (n - 1 - k)
            both = np.where(k < n // 2, low, high).astype(np.float32) if n > 1 else np.array([a32])
            out.append(np.round(both).astype(np.int64).tolist())
        yield pd.Series(out, dtype=object)


def default_sample_fps(count: Column, total: Column, fps: Column) -> Column:
    """Rate of a sampled clip; 2 where the source isn't known."""
    return F.coalesce(count / total * fps, F.lit(2.0))


def video_metadata(frames: Column, fps: Column, sample_fps: Column | None = None, raw_fps: Column | None = None, indices: Column | None = None, times: Column | None = None, total: Column | None = None, image_frames: Column | None = None) -> Column:
    """fps, sample_fps, padded frame numbers, one timestamp for each temporal patch, total frames, error.

    Padding repeats the last frame, but in lists of images without numbers or times of their own it counts on.
    """
    nums, secs = F.lit(None).cast("array<long>"), F.lit(None).cast("array<double>")
    listed = F.lit(False) if image_frames is None else F.coalesce(image_frames, F.lit(False))
    rate = _or(sample_fps, F.lit(2.0))

    def timed(v: Column) -> Column:
        base = F.coalesce(v["nums"], F.sequence(F.lit(0).cast("long"), v["n"] - 1))
        return let_all(filled, v=v, base=base, at=F.coalesce(v["secs"], F.transform(base, lambda i: i.cast("double") / v["fps"])))

    def filled(x: Column) -> Column:
        v, base, at = x["v"], x["base"], x["at"]
        odd = padded(v["n"]) > v["n"]
        count_on = v["listed"] & v["nums"].isNull() & v["secs"].isNull()
        last = F.element_at(base, -1)
        more = F.when(count_on, last + 1).otherwise(last)
        more_s = F.when(count_on, more.cast("double") / v["fps"]).otherwise(F.element_at(at, -1))
        all_n = F.when(odd, F.concat(base, F.array(more))).otherwise(base)
        all_s = F.when(odd, F.concat(at, F.array(more_s))).otherwise(at)
        counted = F.when(v["listed"], padded(v["n"])).otherwise(v["n"]).cast("double")
        return let_all(told, x=x, all_n=all_n, all_s=all_s, whole=F.coalesce(v["total"], counted / v["rate"] * v["fps"]))

    def told(y: Column) -> Column:
        x, v, all_s = y["x"], y["x"]["v"], y["all_s"]

        def wild(c: Column) -> Column:
            return c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf"))

        def in_order(a: Column) -> Column:
            return (F.size(a) == v["n"]) & (a == F.array_sort(a)) & (F.array_min(a) >= 0)

        late = F.array_max(x["at"])
        bad = (v["n"] < 1) | wild(v["rate"]) | wild(v["fps"]) | wild(y["whole"]) | ~in_order(x["base"]) | ~in_order(x["at"]) | F.isnan(late) | (late == float("inf"))
        error = F.when(F.coalesce(bad, F.lit(True)), "media_geometry")
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_s) / 2).cast("int") - 1), lambda k: (F.get(all_s, 2 * k) + F.get(all_s, 2 * k + 1)) / 2)
        fields = {"fps": v["fps"], "sample_fps": v["rate"], "frames_indices": y["all_n"], "timestamps": pairs, "total_num_frames": y["whole"]}
        return F.struct(*(F.when(error.isNull(), c).alias(k) for k, c in fields.items()), error.alias("error"))

    n = F.greatest(frames.cast("long"), F.lit(1).cast("long"))
    return let_all(timed, n=n, rate=rate.cast("double"), fps=_or(raw_fps, fps, rate).cast("double"), listed=listed, nums=nums if indices is None else indices, secs=secs if times is None else times, total=F.lit(None).cast("double") if total is None else total)


def placeholder_count(t: Column, h: Column, w: Column, merge: int = MERGE) -> Column:
    return F.floor(t * h * w / (merge * merge)).cast("long")


def checked_product(values: Column) -> Column:
    """Product of an array of decimal(20,0) as decimal(38,0); null past the unsigned 64-bit range (``arithmetic_overflow``)."""

    def times(a: Column, b: Column) -> Column:
        both = F.try_multiply(a, b.cast("decimal(20,0)")).cast("decimal(38,0)")
        return F.when(both <= F.lit(str(U64)).cast("decimal(38,0)"), both)

    return F.aggregate(values, F.lit(1).cast("decimal(38,0)"), times)


def budgets_ok(lo: Column, hi: Column) -> Column:
    """Item budgets: IMAGE_MIN <= lo <= hi <= IMAGE_MAX."""
    return (lo >= IMAGE_MIN) & (lo <= hi) & (hi <= IMAGE_MAX)


def largest_size(budget: Column, factor: int = FACTOR, aspect: int = ASPECT) -> Column:
    """The largest factor-aligned height and width within a budget and the aspect bound: height, width."""
    cells = F.floor(budget / (factor * factor)).cast("long")
    rows = F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(cells)).cast("long"))
    sizes = F.transform(rows, lambda r: F.struct((r * F.least(F.floor(cells / r).cast("long"), r * aspect)).alias("area"), r.alias("rows"), F.least(F.floor(cells / r).cast("long"), r * aspect).alias("columns")))
    best = F.array_max(sizes)
    return F.struct((best["rows"] * factor).alias("height"), (best["columns"] * factor).alias("width"))
