"""Statistics of measurements and of arrays that should agree: aggregates and windows only, but for SSIM and bootstrap."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(x: str, q: float) -> Column:
    """The value of rank ceil(q * n), as an aggregate."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{x}`)")


def summary(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, p50, p90, p99 (null under 100 values), least and most of each group; percentiles interpolate linearly."""
    n = F.count(x)
    return rows.groupBy(*by).agg(
        n.alias("n"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.9).alias("p90"),
        F.when(n >= 100, F.percentile(x, 0.99)).alias("p99"), F.min(x).alias("least"), F.max(x).alias("most"),
    )


def pair_summary(rows: DataFrame, by: list[str], base: str, new: str) -> DataFrame:
    """Percentiles of two measurements of the same runs, and the median of their ratios."""
    return rows.withColumn("_ratio", F.col(base) / F.col(new)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile(x, q).alias(f"{x}_{k}") for x in (base, new) for k, q in (("p50", 0.5), ("p90", 0.9))), F.percentile("_ratio", 0.5).alias("speedup"),
    )


def channel_metrics(rows: DataFrame, by: list[str], expected: str, actual: str) -> DataFrame:
    """Largest error, RMSE, nearest-rank p99 of the error, bias and mean error of each group. PSNR (255) is null where nothing differs."""
    e = F.col(actual) - F.col(expected)
    rows = rows.withColumn("_e", e).withColumn("_a", F.abs(e))
    mse = F.avg(F.col("_e") * F.col("_e"))
    return rows.groupBy(*by).agg(
        F.max("_a").alias("max_err"), F.sqrt(mse).alias("rmse"), nearest_rank("_a", 0.99).alias("p99"), F.avg("_e").alias("bias"), F.avg("_a").alias("mae"),
        F.when(mse > 0, 10 * F.log10(F.lit(255.0 * 255.0) / mse)).alias("psnr"),
    )


def diagnostics(rows: DataFrame, by: list[str], expected: str, actual: str, place: str, bound: float) -> DataFrame:
    """Size of the errors, how many exceed the bound, and the first place where one does."""
    a = F.abs(F.col(actual) - F.col(expected))
    rows = rows.withColumn("_a", a)
    return rows.groupBy(*by).agg(
        F.max("_a").alias("max_err"), F.sqrt(F.avg(F.col("_a") * F.col("_a"))).alias("rmse"),
        *(F.percentile("_a", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.99)),
        F.count_if(F.col("_a") > bound).alias("over"), F.min(F.when(F.col("_a") > bound, F.col(place))).alias("first"),
    )


def exclusive(spans: DataFrame, trace: list[str]) -> DataFrame:
    """Duration of each span less that of the spans right inside it. spans: trace columns, id, parent, name, duration."""
    inner = spans.where("parent is not null").groupBy(*trace, F.col("parent").alias("id")).agg(F.sum("duration").alias("_inner"))
    return spans.join(inner, [*trace, "id"], "left").withColumn("exclusive", F.col("duration") - F.coalesce("_inner", F.lit(0))).drop("_inner")


def stage_ranking(spans: DataFrame, by: list[str]) -> DataFrame:
    """Of each stage: total and mean (whole) exclusive time, count, and its share of all. Few rows: the window runs over the sums."""
    sums = spans.groupBy(*by, "name").agg(F.sum("exclusive").alias("total"), F.count(F.lit(1)).alias("n"))
    share = F.col("total") / F.sum("total").over(Window.partitionBy(*by))
    return sums.select(*by, "name", "total", F.floor(F.col("total") / F.col("n")).cast("long").alias("mean"), "n", share.alias("share"))


def high_water(events: DataFrame, trace: list[str], order: list[str], delta: str) -> DataFrame:
    """Live bytes at the end and at the highest, of each trace."""
    upto = Window.partitionBy(*trace).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    live = events.withColumn("_live", F.sum(delta).over(upto))
    return live.groupBy(*trace).agg(F.greatest(F.max("_live"), F.lit(0)).alias("peak"), F.sum(delta).alias("live"))


def stack_ranking(lines: DataFrame, stack: str = "stack", samples: str = "samples") -> DataFrame:
    """Of each frame of ``a;b;c`` stacks: samples in which it occurs, and in which it is the last; share of all samples."""
    frames = F.split(stack, ";")
    each = lines.select(F.col(samples).alias("n"), F.explode(F.array_distinct(frames)).alias("frame"), F.element_at(frames, -1).alias("leaf"))
    sums = each.groupBy("frame").agg(F.sum("n").alias("inclusive"), F.sum(F.when(F.col("frame") == F.col("leaf"), F.col("n")).otherwise(0)).alias("self"))
    total = lines.agg(F.sum(samples).alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("frame", "inclusive", "self", (F.col("inclusive") / F.col("all")).alias("share"))  # total: one row


def process_noise(rows: DataFrame, by: list[str], process: str, x: str, bound: float = 0.05) -> DataFrame:
    """Spread of the medians of each process over their mean, and whether it is within the bound."""
    medians = rows.groupBy(*by, process).agg(F.percentile(x, 0.5).alias("_m"))
    noise = F.coalesce(F.stddev_samp("_m"), F.lit(0.0)) / F.avg("_m")
    return medians.groupBy(*by).agg(F.count(F.lit(1)).alias("processes"), noise.alias("noise"), (noise <= bound).alias("steady"))


def coverage(rows: DataFrame, by: list[str], tags: str, required: list[str]) -> DataFrame:
    """Tags seen in each group, and those that are missing."""
    seen = rows.select(*by, F.explode_outer(tags).alias("_t")).groupBy(*by).agg(F.array_sort(F.collect_set("_t")).alias("seen"))
    return seen.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("seen"))))


def serving_medians(rows: DataFrame, by: list[str], mode: str, x: str, base: str = "official", new: str = "native") -> DataFrame:
    """Median of each of two modes, a column each, and the change of the new one in percent of the other."""
    middle = {m: F.expr(f"percentile(`{x}`, 0.5) FILTER (WHERE `{mode}` = '{m}')").alias(m) for m in (new, base)}
    out = rows.groupBy(*by).agg(*middle.values())
    return out.withColumn("change", (F.col(new) / F.col(base) - 1) * 100)


def signature(rows: DataFrame, by: list[str], order: str, text: Column) -> DataFrame:
    """SHA-256 of each group's texts, in order, by commas. Groups are the outputs of one case, which its limits bound."""
    listed = rows.select(*by, F.struct(F.col(order).alias("k"), text.alias("t")).alias("_v")).groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    return listed.select(*by, F.sha2(F.array_join(F.transform("_v", lambda v: v["t"]), ","), 256).alias("signature"))


def difference(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that only one of two manifests has, or that have different values there."""
    both = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


#: Bounds of a release, on the lower bound of the speedup (of one request and of a batch), the ratio of text times, the efficiency on eight cores and the ratio of memory.
GATES = {"speedup": 1.0, "batch_speedup": 2.0, "text_ratio": 1.05, "efficiency": 0.6, "memory_ratio": 0.5}


def release_gates(rows: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """Adds ``failed``, the names of the gates that a case doesn't pass; what wasn't measured (null) isn't judged.

    rows: batch (boolean), speedup_low, text_ratio, efficiency, memory_ratio.
    """
    least = F.when(F.col("batch"), F.col("speedup_low") >= gates["batch_speedup"]).otherwise(F.col("speedup_low") > gates["speedup"])
    passed = {"speedup": least, "text_ratio": F.col("text_ratio") <= gates["text_ratio"], "efficiency": F.col("efficiency") >= gates["efficiency"], "memory_ratio": F.col("memory_ratio") <= gates["memory_ratio"]}
    return rows.withColumn("failed", F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in passed.items()))))


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many single-precision numbers apart."""
    x, y = (np.asarray(v, dtype=np.float32).view(np.int32).astype(np.int64) for v in (a, b))
    x, y = (np.where(v < 0, -(v & 0x7FFFFFFF), v) for v in (x, y))
    return np.abs(x - y)


#: Draws of resampling that are held at a time, or those of one resample if it has more.
DRAWS = 1 << 19


def bootstrap_bounds(values: Sequence[float], seed: int, resamples: int = 20_000, level: float = 0.95) -> tuple[float, float]:
    """Interval of the median under resampling, by linear percentiles. The draws are those of ``random.Random(seed).choices``."""
    values = np.sort(np.asarray(values, dtype=np.float64))
    n = len(values)
    if not n or values[0] == values[-1]:
        return (float(values[0]), float(values[-1])) if n else (float("nan"),) * 2
    *key, at = random.Random(seed).getstate()[1]
    r = np.random.RandomState()
    r.set_state(("MT19937", key, at))  # the same generator
    medians, step = np.empty(resamples), max(1, DRAWS // n)
    middle = [(n - 1) // 2, n // 2]
    for a in range(0, resamples, step):
        draws = r.random_sample((min(step, resamples - a), n))
        draws *= n
        draws = draws.astype(np.int32)  # places of sorted values, so the middle place has the middle value
        draws.partition(sorted(set(middle)), axis=1)
        medians[a : a + step] = values[draws[:, middle]].mean(axis=1)
    low, high = np.quantile(medians, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def bootstrap(rows: DataFrame, by: list[str], x: str, seed: int = 1, resamples: int = 2000) -> DataFrame:
    """Median of each group and its bootstrap interval. A task holds the values of one group, and ``DRAWS`` of its resamples at a time."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_bounds(pdf[x].dropna(), seed, resamples)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "median": float(pdf[x].median()), "low": low, "high": high}])

    return rows.select(*by, F.col(x).cast("double").alias(x)).groupBy(*by).applyInPandas(run, f"{kinds}, median double, low double, high double")


def ssim(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5, peak: float = 255.0) -> float:
    """Mean structural similarity of two planes under a Gaussian window, edges mirrored."""
    at = np.arange(size) - size // 2
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            k = size // 2
            width = [(k, k) if i == axis else (0, 0) for i in (0, 1)]
            p = np.pad(x, width, mode="reflect" if x.shape[axis] > k else "symmetric")
            x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(g))
        return x

    a, b = a.astype(float), b.astype(float)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())
