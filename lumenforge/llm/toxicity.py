"""Toxicity by weak supervision.

1. Voters. A lexicon: terms (whole words and word beginnings) that a grouped count finds to mark toxic rows among the
   learning rows; each one votes "toxic" where it occurs. Patterns: words of a fixed lexicon, several hits or different hits, hits that are
   dense or stand near each other, exclamation and question marks in number or in a row, masked letters; long texts without a hit, and
   texts without any, vote "not toxic".
2. Label model. The votes alone are explained by a hidden label: EM, from a vote in which voters that say the same share one voice, estimates how
   often each voter speaks under either label, and discounts voters by their correlation with the others given
   the label, so a word and its beginnings count about once. No label of a row is a voter; labels chose the lexicon, and choose the cut at the end.
3. A linear classifier of the term counts is trained on the posterior labels, and its scores
   are stretched so that 0.7 is the cut of the best F1 on the learning rows.

Only labelled rows whose crc32(doc_id) mod 3 is not 1 are learned from, at most ``SAMPLE``
of them (those of the least hashes). Every text is scored whole; labels, lang, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import scratch
from .common import unit
from .textscan import chunks, mix64, pieces, runs

#: The most labelled rows that are learned from, and the most terms.
SAMPLE, TERMS = 12_000, 256
#: Rows that the driver looks at together.
BLOCK = 1024
CUT = 0.7
LEXICON = (
    "idiot idiots moron morons stupid trash pathetic worthless disgusting clown clowns scum loser losers dumb imbecile bastard vermin "
    "garbage filth filthy retard retarded idiote connard connasse salope abruti débile ordure dummkopf arschloch trottel vollidiot abschaum "
    "idiota imbécil estúpido estúpida cabrón basura asqueroso"
).split()
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LENGTHS = (4, 5, 6, 7, 8, 9)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of whole words, then of their beginnings by length (0 where the word is shorter), and each word's text."""
    hashed, starts, ends, of = runs(data, offsets, _LETTER)
    out = [hashed(starts, ends)]
    for n in _LENGTHS:
        long = ends - starts > n
        out.append(np.where(long, mix64(hashed(starts, np.minimum(starts + n, ends)) + np.uint64(n)), np.uint64(0)))
    return out, of


def _hash_words(some: list[str]) -> np.ndarray:
    data, offsets = np.frombuffer(" ".join(some).encode(), np.uint8), np.array([0, len(" ".join(some).encode())])
    return _terms(data, offsets)[0][0]


def _signs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: exclamation marks, those after another, question marks, and stars or dollar signs between letters."""
    loud, letter = data == 33, _LETTER[data]
    twice, masked = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    twice[1:] = loud[1:] & loud[:-1]
    masked[1:-1] = ((data[1:-1] == 42) | (data[1:-1] == 36)) & letter[:-2] & letter[2:]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (loud, twice, data == 63, masked)]
    return np.stack([x[offsets[1:]] - x[offsets[:-1]] for x in sums], axis=1)


def counts(texts: pa.Array, terms: np.ndarray, lexicon: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, counts of each term by text, [words, lexicon hits, and what ``_signs`` counts] by text)."""
    order = np.argsort(terms)
    sought = np.concatenate([terms, lexicon])
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(sought & np.uint64(0xFFFF)).astype(np.int64)] = True
    for a, b, data, offsets in chunks(texts, lower=True):
        n = b - a
        found, other = np.zeros(n * max(1, len(terms)), dtype=np.int64), np.zeros((n, 6), dtype=np.int64)
        for part, cut in pieces(data, offsets, _LETTER):
            kinds, of = _terms(part, cut)
            for i, hashed in enumerate(kinds):
                at = np.flatnonzero(maybe[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
                h, d = hashed[at], of[at]
                if len(terms):
                    k = order[np.minimum(np.searchsorted(terms, h, sorter=order), len(terms) - 1)]
                    hit = terms[k] == h
                    found += np.bincount(d[hit] * len(terms) + k[hit], minlength=len(found))
                if i == 0:
                    other[:, 1] += np.bincount(d[np.isin(h, lexicon)], minlength=n)
            other[:, 0] += np.bincount(of, minlength=n)
            other[:, 2:] += _signs(part, cut)
        yield a, b, found.reshape(n, -1)[:, : len(terms)], other


def features(found: np.ndarray, other: np.ndarray) -> np.ndarray:
    n = np.maximum(other[:, :1], 1)
    hits = found.sum(axis=1, keepdims=True)
    rate = np.concatenate([hits, other[:, 1:2]], axis=1) / np.sqrt(n)
    return np.concatenate([np.log1p(found), np.log1p(rate), np.log1p(other[:, 1:2]), np.log1p(other[:, 2:3]) / 4, np.ones_like(n)], axis=1).astype(float)


def votes(found: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 (toxic), -1 (not toxic) or 0 (no vote) of each voter, by text."""
    n, kinds, hits, swears = np.maximum(other[:, 0], 1), (found > 0).sum(axis=1), found.sum(axis=1), other[:, 1]
    loud, twice, asked, masked = other[:, 2:6].T
    yes = [swears > 0, swears > 1, swears > 0.01 * n, kinds > 1, kinds > 3, kinds > 6, hits > 2, hits > 0.005 * n, hits > 0.02 * n, hits > 0.05 * n]
    yes += [loud > 0.02 * n, loud > 0.05 * n, twice > 0, asked > 0.05 * n, masked > 0, (loud + twice > 0) & (kinds > 0)]
    none = (hits == 0) & (swears == 0)
    no = [none, none & (n >= 100), none & (loud == 0), (kinds == 1) & (hits == 1) & (n >= 300)]
    return np.concatenate([found > 0, np.stack(yes, axis=1), -np.stack(no, axis=1).astype(np.int8)], axis=1).astype(np.int8)


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]


def _alike(v: np.ndarray, post: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Correlations of the voters around ``ones`` and ``zeros``, their means under either label, weighed by ``post``."""
    together = np.zeros((v.shape[1],) * 2)
    for a, b in _blocks(len(v)):
        centred = v[a:b] - np.outer(post[a:b], ones) - np.outer(1 - post[a:b], zeros)
        together += centred.T @ centred
    together /= len(v)
    sd = np.sqrt(np.diag(together)) + 1e-9
    return together / np.outer(sd, sd)


def label_model(v: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden label of each row, and of each voter: odds to vote -1, 0 and 1 under label 1, then under label 0.

    Label 1 is taken to hold for at most half of the rows, and no voter to be worse than chance. Beside the votes no more than ``BLOCK`` rows are held at a time.
    """
    mean, n = v.mean(axis=0), len(v)
    alike = _alike(v, np.zeros(n), mean, mean) ** 2  # about 1 for voters that say the same
    alone = 1 / np.maximum(alike.sum(axis=1), 1)
    post = first = np.clip(1 / (1 + np.exp(-3 * np.concatenate([v[a:b] @ alone for a, b in _blocks(n)]))), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 0.01, 0.5)
        both = np.stack([post, 1 - post])
        said = sum(np.stack([both[:, a:b] @ (v[a:b] == x) for x in (-1, 0, 1)], axis=1) for a, b in _blocks(n))
        told = [(p + 0.5) / (p + 0.5).sum(axis=0) for p in said]
        for i, wrong in ((0, told[0][0] > told[1][0]), (2, told[0][2] < told[1][2])):
            half = (told[0][i] + told[1][i]) / 2
            told[0][i], told[1][i] = np.where(wrong, half, told[0][i]), np.where(wrong, half, told[1][i])
        ones, zeros = (said[:, 2] - said[:, 0]) / both.sum(axis=1)[:, None]
        together = np.maximum(_alike(v, post, ones, zeros), 0)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + together.sum(axis=1))
        speaks = [weight * np.log(told[0][i] / told[1][i]) for i in range(3)]
        odds = np.concatenate([sum((v[a:b] == x) @ k for x, k in zip((-1, 0, 1), speaks, strict=True)) for a, b in _blocks(n)])
        post = np.clip(1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + odds, -30, 30))), 1e-4, 1 - 1e-4)
    lost = (first > 0.5).any() and not (post > 0.5).any()  # few rows may not carry the model
    return first if lost else post, np.concatenate(told)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(odds: np.ndarray, label: np.ndarray) -> float:
    """Midpoint of the cut with the best F1."""
    order = np.argsort(-odds, kind="stable")
    o, y = odds[order], label[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][o[:-1] == o[1:]] = -1
    i = int(np.argmax(f1))
    return float((o[i] + (o[i + 1] if i + 1 < len(o) else o[i] - 1)) / 2)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of at most ``sample`` labelled rows that may be learned from; copies count once."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(unit(F.col("doc_id"), "/learn"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return scratch.table(rows.select("text", "toxic"), "learning")


def find_terms(rows: DataFrame, positive: int, negative: int, most: int) -> np.ndarray:
    """Hashes of the terms that mark toxic rows best: a count of rows by term, then the gain of likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for a, b, data, offsets in chunks(batch.column("text"), lower=True):
                kinds, of = _terms(data, offsets)
                every, who = np.concatenate(kinds), np.tile(of, len(kinds))
                every, who = every[every != 0], who[every != 0]
                order = np.lexsort((who, every))
                every, who = every[order], who[order]
                fresh = np.ones(len(every), dtype=bool)
                fresh[1:] = (every[1:] != every[:-1]) | (who[1:] != who[:-1])
                every, who = every[fresh], who[fresh]
                values, at = np.unique(every, return_inverse=True)
                pos = np.bincount(at, weights=toxic[a:b][who] == 1, minlength=len(values)).astype(np.int64)
                n = np.bincount(at, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(pos), pa.array(n - pos)], ["term", "pos", "neg"])

    found = rows.mapInArrow(run, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 0.5) / (positive + 1), (F.col("neg") + 0.5) / (negative + 1)
    both = (F.col("pos") + F.col("neg") + 1) / (positive + negative + 2)

    def told(x: Column, n: int) -> Column:
        return n * (x * F.log(x / both) + (1 - x) * F.log((1 - x) / (1 - both)))

    gain = told(p, positive) + told(q, negative)
    sure = found.where((F.col("pos") >= 3) & (F.log(p / q) >= 2.5)).select("term", gain.alias("gain")).where("gain >= 5")
    best = sure.orderBy(F.desc("gain"), "term").limit(most).collect()
    return np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = TERMS) -> dict:
    """Terms, weights and cut. With fewer than 3 rows of either label the fixed lexicon decides alone."""
    rows = learning_rows(docs, labels, sample)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = _hash_words(LEXICON)
    if n.get(1, 0) < 3 or n.get(0, 0) < 3:
        return {"terms": np.zeros(0, np.uint64), "lexicon": lexicon, "w": np.array([0.0, 1.0, 2.0, 0.0, -1.0]), "cut": 0.2}
    terms = find_terms(rows, n.get(1, 0), n.get(0, 0), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, other in counts(batch.column("text"), terms, lexicon):
                raw = [zlib.compress(x.tobytes(), 1) for x in np.concatenate([found, other], axis=1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), pa.array(raw, pa.binary())], ["toxic", "raw"])

    got = [(r["toxic"], bytes(r["raw"])) for r in rows.mapInArrow(run, "toxic int, raw binary").collect()]
    w, cut = learn(got, len(terms))
    return {"terms": terms, "lexicon": lexicon, "w": w, "cut": cut}


def learn(got: list[tuple[int, bytes]], n_terms: int) -> tuple[np.ndarray, float]:
    """Weights and cut, from each learning row's label and its counts as deflated 32-bit integers."""
    got = sorted((t, zlib.decompress(r)) for t, r in got)
    label = np.array([t for t, _ in got])
    every = np.frombuffer(b"".join(r for _, r in got), dtype=np.int32).reshape(len(got), -1)
    del got
    found, other = every[:, :n_terms], every[:, n_terms:]
    parts = _blocks(len(every))
    x = np.empty((len(every), features(found[:1], other[:1]).shape[1]))
    for a, b in parts:
        x[a:b] = features(found[a:b], other[a:b])
    w = fit_linear(x, label_model(np.concatenate([votes(found[a:b], other[a:b]) for a, b in parts]))[0])
    return w, best_cut(x @ w, (label == 1).astype(int))


def score(docs: DataFrame, model: dict, by: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """doc_id, the columns ``by`` and the score, called ``name``, of every row."""
    terms, lexicon, w, cut = model["terms"], model["lexicon"], model["w"], model["cut"]
    names = ["doc_id", *by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, other in counts(batch.column("text"), terms, lexicon):
                odds = features(found, other) @ w - cut + np.log(CUT / (1 - CUT))
                s = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in names), pa.array(s)], [*names, name])

    rows = docs.select("doc_id", "text", *(x for x in by if x != "text"))
    return rows.mapInArrow(run, StructType([*docs.select(*names).schema, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every text for toxicity.

    docs: doc_id, text; labels: doc_id, toxic (1 or 0); other columns are ignored. Returns one row per row of docs:
    doc_id, held_out, score, predicted. Null and empty texts get the score of a text without
    any hit. Labels that are null, or of a null doc_id, are not learned from; where a doc_id
    has several, the highest holds. Rows that repeat a doc_id are each scored by their own text. An empty
    table gives an empty result; without labels of both kinds the fixed lexicon decides.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
