from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import geometry as G


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "f", "want"), [(16, 32, 0), (48, 32, 64), (80, 32, 64), (112, 32, 128), (15, 32, 0), (33, 32, 32)])
def test_round_by_factor(spark, n, f, want):
    assert one(spark, G.round_by_factor(F.lit(n), f)) == want


def python_resize(h, w, f, lo, hi):
    """By the rule, in exact rounding and doubles."""
    from fractions import Fraction
    from math import ceil, floor, sqrt

    if hi < lo or max(h, w) > 200 * min(h, w):
        return None
    a, b = (max(f, round(Fraction(x, f)) * f) for x in (h, w))
    if a * b > hi:
        s = sqrt(h * w / hi)
        a, b = (floor(x / s / f) * f for x in (h, w))
    elif a * b < lo:
        s = sqrt(lo / (h * w))
        a, b = (ceil(x * s / f) * f for x in (h, w))
    return (a, b) if a and b else None


def test_smart_resize(spark):
    r = np.random.default_rng(1)
    cases = [(int(h), int(w), int(lo), int(hi)) for h, w, lo, hi in zip(r.integers(1, 6000, 300), r.integers(1, 6000, 300), r.choice([4096, 65536, 10**6], 300), r.choice([65536, 10**6, 16777216], 300), strict=True)]
    df = spark.createDataFrame(cases, "h long, w long, lo long, hi long")
    for row in df.select("*", G.smart_resize(F.col("h"), F.col("w"), 32, F.col("lo"), F.col("hi")).alias("s")).collect():
        got = (row.s.height, row.s.width) if row.s.error is None else None
        assert got == python_resize(row.h, row.w, 32, row.lo, row.hi), row


def test_image_plan(spark):
    n = F.lit(None).cast("long")
    p = one(spark, G.image_plan(F.lit(768), F.lit(1024)))
    assert (p.height, p.width, p.grid_h, p.grid_w, p.patch_rows, p.placeholder_count, p.error) == (768, 1024, 48, 64, 3072, 768, None)
    assert one(spark, G.image_plan(F.lit(100), F.lit(20001))).error == "media_geometry"
    assert one(spark, G.image_plan(F.lit(100), F.lit(100), n, n, F.lit(64), n)).error == "media_geometry"
    assert one(spark, G.image_plan(F.lit(40000), F.lit(400))).error == "resource_limit"
    explicit = one(spark, G.image_plan(F.lit(100), F.lit(100), F.lit(10**6), n, F.lit(64), F.lit(96)))
    assert (explicit.height, explicit.width) == (64, 96)


def test_video(spark):
    p = one(spark, G.video_plan(F.lit(192), F.lit(256), F.lit(7)))
    assert (p.grid_t, p.error) == (4, None)
    assert p.height * p.width <= 786432
    ready = one(spark, G.video_plan(F.lit(100), F.lit(96), F.lit(2), preprocessed=F.lit(True)))
    assert ready.error == "media_geometry"
    assert one(spark, G.video_plan(F.lit(96), F.lit(64), F.lit(2), preprocessed=F.lit(True))).height == 96
    assert one(spark, G.video_plan(F.lit(96), F.lit(64), F.lit(800))).error == "resource_limit"


def test_video_metadata(spark):
    m = one(spark, G.video_metadata(F.lit(3), F.lit(10.0)))
    assert m.timestamps == [0.05, 0.2] and m.frames_indices == [0, 1, 2, 2] and m.total_num_frames == 15.0
    listed = one(spark, G.video_metadata(F.lit(3), F.lit(None).cast("double"), F.lit(2.0), image_frames=F.lit(True)))
    assert listed.frames_indices == [0, 1, 2, 3] and listed.timestamps == [0.25, 1.25]
    late = one(spark, G.video_metadata(F.lit(2), F.lit(10.0), times=F.array(F.lit(2.0), F.lit(1.0))))
    assert late.error == "media_geometry"
    assert one(spark, G.video_metadata(F.lit(2), F.lit(-1.0))).error == "media_geometry"


def test_sampling(spark):
    df = spark.createDataFrame([(0, 10, 5), (0, 0, 1), (3, 99, 4)], "a long, b long, n long")
    assert [r[0] for r in df.select(G.sample_indices("a", "b", "n")).collect()] == [[0, 2, 5, 8, 10], [0], [3, 35, 67, 99]]
    assert [one(spark, G.nframes_explicit(F.lit(n), F.lit(10))) for n in (1, 3, 5, 11, 13)] == [None, 4, 4, None, None]
    assert one(spark, G.nframes_by_rate(F.lit(100), F.lit(25.0))) == 8
    assert one(spark, G.nframes_by_rate(F.lit(1), F.lit(25.0))) == 1


def test_products(spark):
    d = [F.lit(x).cast("decimal(20,0)") for x in ("4294967296", "4294967296", "18446744073709551615", "1", "0")]
    assert one(spark, G.checked_product(F.array(d[0], d[1]))) is None
    assert one(spark, G.checked_product(F.array(d[2], d[3]))) == Decimal(18446744073709551615)
    assert one(spark, G.checked_product(F.array(d[4], d[2]))) == 0
