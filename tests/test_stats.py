from __future__ import annotations

import numpy as np

from lumenforge.functions import stats as S
from lumenforge.operators import layout as L
from lumenforge.sources import requests as R


def test_ssim():
    x = np.random.default_rng(1).integers(0, 256, (40, 30)).astype(float)
    assert abs(S.ssim(x, x) - 1) < 1e-9 and S.ssim(x, 255 - x) < 0
    assert 0.5 < S.ssim(x, np.clip(x + 20, 0, 255)) < 1


def test_bootstrap():
    low, high = S.bootstrap_bounds([1.0, 2.0, 3.0, 4.0, 100.0], 3, 2000)
    assert 1 <= low < 3 < high <= 100 and (low, high) == S.bootstrap_bounds([100.0, 2.0, 3.0, 4.0, 1.0], 3, 2000)
    assert S.bootstrap_bounds([2.0, 2.0], 1) == (2.0, 2.0)


def test_bootstrap_draws_and_memory():
    """The draws are those of random.choices, and they aren't held all at once."""
    import random
    import tracemalloc

    for n in (2, 7, 1000):
        values = sorted(np.random.default_rng(n).normal(size=n).round(2).tolist())
        r = random.Random(n)
        medians = np.median(np.array([r.choices(values, k=n) for _ in range(700)]), axis=1)
        assert S.bootstrap_bounds(values[::-1], n, 700) == tuple(np.quantile(medians, [0.025, 0.975]).tolist())
    tracemalloc.start()
    S.bootstrap_bounds(np.arange(20_000.0), 1, 500)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6


def test_ulp():
    a = np.array([1.0, -0.0, 1.0], np.float32)
    b = np.array([np.nextafter(np.float32(1), np.float32(2)), 0.0, 1.0], np.float32)
    assert S.ulp_distance(a, b).tolist() == [1, 0, 0]


def test_batch_limits(spark):
    rows = spark.createDataFrame([(1, 200, 0), (1, 100, 0), (2, 1, 5)], "batch_id long, media long, encoded_bytes long")
    assert [(r.batch_id, r.message) for r in L.batch_errors(rows).collect()] == [(1, "media_per_batch")]


def test_defaults_and_aliases(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"role":"user","content":"x","zeta":1,"alpha":2}', None), ("{}", "u")], "j string, u string")
    assert [r[0] for r in df.select(R.unknown_keys(F.col("j"), "message")).collect()] == [["alpha", "zeta"], []]
    kinds = df.select(R.strict_kind(F.lit('{"a": true}'), "$.a"), R.strict_kind(F.lit('{"a": 1}'), "$.a")).first()
    assert kinds[0] == "BOOLEAN" and kinds[1] == "BIGINT"
    assert [r[0] for r in df.select(R.one_alias(F.col("u"), F.lit(None))).collect()] == [False, True]
