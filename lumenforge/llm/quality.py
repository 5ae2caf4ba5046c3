"""Quality of documents by hierarchical empirical Bayes.

1. Evidence. A classifier of text shape (word lengths, capitals, symbols, repetition, each
   cut into bins of the learning rows) gives every document a log likelihood ratio of good to bad.
2. Global prior. The share of good documents that explains the evidence of all documents, by EM
   over a histogram of it: the histogram has ``BINS`` cells, whatever the input.
3. Sites. Expected good documents are summed by path and host, with partial sums before any shuffle.
   Host posteriors shrink to the global prior, path posteriors to their host's; how much is
   estimated from how far hosts and paths really differ (a beta-binomial's overdispersion).
   A document's own part is left out of its site's sums, so it isn't counted twice.
4. The posterior of a document joins its path's prior with its evidence.

Learned from are at most ``SAMPLE`` labelled rows whose crc32(doc_id) mod 3 is not 1; all
other sums and counts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .common import unit
from .textscan import chunks, shingles, words
from .toxicity import fit_linear, held_out

SAMPLE, CUTS, BINS, REACH, CUT = 12_000, 8, 512, 16.0, 0.5


def _marks(chars: str | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT, _HIGH = _marks(range(65, 91)), _marks(range(97, 123)), _marks(range(48, 58)), _marks(range(128, 256))
_CLASSES = {
    "digit": _DIGIT,
    "stop": _marks(".,;:'"),
    "loud": _marks("!?"),
    "pipe": _marks("|\\/_"),
    "odd": _marks("#$%&*+=@^~`"),
    "angle": _marks("<>{}[]()"),
    "quote": _marks("\"-"),
    "line": _marks("\n"),
    "control": _marks([*range(0, 9), *range(14, 32), 127]),
    "high": _HIGH,
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each text, one text a row; a text without words is all zero but for its length."""
    n_bytes = np.diff(offsets)

    def count(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    hashed, first = words(data, offsets)
    n = np.diff(first).astype(float)
    some, size = np.maximum(n, 1), np.maximum(n_bytes, 1)
    upper, lower = count(_UPPER[data]), count(_LOWER[data])
    letters = np.maximum(upper + lower, 1)
    space = count(_marks(" \t\n\r\x0b\x0c")[data])
    twice = np.zeros(len(data), dtype=bool)
    if len(data):
        twice[1:] = (data[1:] == data[:-1]) & ~(_UPPER | _LOWER | _DIGIT | _HIGH)[data[1:]]
    out = [np.log1p(n), (n_bytes - space) / some, upper / letters, count(twice) / some, space / size]
    out += [count(mark[data]) / some for mark in _CLASSES.values()]
    for width in (1, 3):
        distinct = np.diff(shingles(hashed, first, width)[1])
        whole = np.maximum(n - width + 1, 1)
        out.append(distinct / whole)
        out.append(np.minimum(whole - distinct, 50))
    return np.stack(out, axis=1)


class Evidence:
    """A logistic regression over binned features; its log odds less those of its learning rows."""

    def __init__(self, x: np.ndarray, good: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, CUTS) / CUTS)) for j in range(x.shape[1])]
        self.base = float(np.log(good.mean() / (1 - good.mean())))
        self.w = fit_linear(self._binned(x), good.astype(float), ridge=0.5)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = [np.eye(len(e) + 1)[np.searchsorted(e, x[:, j], "left")] for j, e in enumerate(self.edges)]
        return np.concatenate([*out, np.ones((len(x), 1))], axis=1)

    def ratios(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._binned(x) @ self.w - self.base, -REACH, REACH)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence | None:
    """None with fewer than 3 learning rows of either label: there is no evidence then."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = ids.orderBy(unit(F.col("doc_id"), "/quality"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                raw = [r.tobytes() for r in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), pa.array(raw, pa.binary())], ["quality", "raw"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("quality", "text")
    got = sorted((r["quality"], bytes(r["raw"])) for r in rows.mapInArrow(run, "quality int, raw binary").distinct().collect())
    good = np.array([q == 1 for q, _ in got])
    if good.sum() < 3 or (~good).sum() < 3:
        return None
    return Evidence(np.frombuffer(b"".join(r for _, r in got)).reshape(len(got), -1), good)


def evidence(docs: DataFrame, model: Evidence | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and llr of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    if model is None:
        return rows.select("doc_id", "host", "path", F.lit(0.0).alias("llr"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                llr = pa.array(model.ratios(features(data, offsets)))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("doc_id", "host", "path")), llr], ["doc_id", "host", "path", "llr"])

    return rows.mapInArrow(run, f"doc_id {kind}, host string, path string, llr double")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def global_prior(rows: DataFrame, start: float = 0.5, rounds: int = 200) -> float:
    """Share of good documents, by EM over a histogram of the evidence."""
    cell = F.least(F.floor((F.col("llr") + REACH) / (2 * REACH) * BINS), F.lit(BINS - 1))
    got = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("llr").alias("llr")).collect()
    if not got:
        return start
    n, llr = np.array([r["n"] for r in got], float), np.array([r["llr"] for r in got])
    share = start
    for _ in range(rounds):
        before = share
        share = float(np.clip((n / (1 + np.exp(-(np.log(share / (1 - share)) + llr)))).sum() / n.sum(), 1e-3, 1 - 1e-3))
        if abs(share - before) < 1e-7:
            break
    return share


def _strength(spread: float, groups: float, total: float) -> float:
    """Pseudo-documents of a beta prior: ``spread`` is the sum of n * (mean - parent)**2 / (parent * (1 - parent)) over ``groups``."""
    rho = (spread - groups) / max(total - groups, 1.0)
    return 1 / min(max(rho, 1e-3), 0.9) - 1


def sites(rows: DataFrame, prior: float) -> tuple[DataFrame, float, float]:
    """Sums of each path and its host, and the strengths of the priors of hosts and paths."""
    good = _logistic(F.col("llr") + F.lit(float(np.log(prior / (1 - prior)))))
    paths = scratch.table(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")), "paths")
    hosts = scratch.table(paths.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")

    def spread(n: str, mean: Column, parent: Column) -> Column:
        parent = F.least(F.greatest(parent, F.lit(1e-3)), F.lit(1 - 1e-3))
        return F.sum(F.col(n) * (mean - parent) ** 2 / (parent * (1 - parent)))

    h = hosts.agg(spread("host_n", F.col("host_good") / F.col("host_n"), F.lit(prior)), F.count(F.lit(1)), F.sum("host_n")).first()
    k_host = _strength(h[0] or 0.0, h[1], h[2] or 0.0)
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    p = both.agg(spread("n", F.col("good") / F.col("n"), F.col("host_good") / F.col("host_n")), F.count(F.lit(1)), F.sum("n")).first()
    return both, k_host, _strength(p[0] or 0.0, max(p[1] - h[1], 1), p[2] or 0.0)


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE) -> DataFrame:
    """Posterior odds that each document is good, and whether to keep it.

    docs: doc_id, text and what ``host`` and ``path`` are made of; labels: doc_id, quality (1 good, 0 bad). Returns one
    row per row of docs: doc_id, held_out, score (posterior, 0 to 1), evidence (log likelihood ratio), site_prior (of
    its path, without itself), kept (score >= 0.5). Null text is empty text. Null hosts are one host, null
    paths one path of their host. Labels that are null, or of a null doc_id, are not learned from;
    where a doc_id has several, the lowest holds. Rows that repeat a doc_id are scored each. An empty table gives an
    empty result; without labels of both kinds there is no evidence, and every document is kept.
    """
    rows = scratch.table(evidence(docs, fit(docs, labels, sample), host, path), "evidence")
    prior = global_prior(rows)
    both, k_host, k_path = sites(rows, prior)
    both = both.withColumnRenamed("host", "_host").withColumnRenamed("path", "_path")
    found = rows.join(both, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own = _logistic(F.col("llr") + F.lit(float(np.log(prior / (1 - prior)))))
    of_host = (F.col("host_good") - own + k_host * prior) / (F.col("host_n") - 1 + k_host)
    of_path = (F.col("good") - own + k_path * of_host) / (F.col("n") - 1 + k_path)
    site = F.least(F.greatest(of_path, F.lit(1e-4)), F.lit(1 - 1e-4))
    found = found.withColumn("site_prior", site)
    found = found.withColumn("score", _logistic(F.log(F.col("site_prior") / (1 - F.col("site_prior"))) + F.col("llr")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("llr").alias("evidence"), "site_prior", (F.col("score") >= CUT).alias("kept"))
