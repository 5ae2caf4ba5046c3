"""Secrets, toxicity, decontamination and quality."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import decontaminate, quality, scratch, secrets, toxicity
from lumenforge.llm.textscan import common_length

from .conftest import prose


def base(text):
    """The three patterns by the letter of the contract."""
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def secret_rows(spark, texts):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("abcdefXYZ0123456789") for _ in range(n))
    made = ["é password = hunter22", "API-key: no", "api_key:'abc'", 'Token="' + key(30) + '" and secret=' + key(8), "AKIA" + "A1" * 9, "AKIA" + "A" * 16, "xAKIAAKIA" + "B2" * 10]
    made += ["ß" * 10 + "deadbeef" * 4, "0123456789abcdef0123456789ABCDEF", "passwd:" + key(5), "ſecret=abcdef1", "tokenpassword==abcdefg", "key " + key(40) + " end"]
    made += [prose(r, 50) + " apikey=" + key(20) + " " + prose(r, 50) for _ in range(20)]
    rows = [(10000 + i, t, i) for i, t in enumerate(made)] + [(i, t, i) for i, t in texts] + [(None, "secret: abcdef99", 0), (7, None, 0), (7, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)


def test_secrets(secret_rows, empty):
    net = secrets.fit(secret_rows, 200)
    got = secrets.find_secrets(secret_rows, net).collect()
    text = {r.doc_id: r.text or "" for r in secret_rows.collect()}
    assert len(got) == secret_rows.count()
    for g in got:
        want = base(text[g.doc_id])
        names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == i for k, *_ in want) for i in range(3)), text[g.doc_id]
        assert g.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        spans = [x.split(":") for x in g.spans.split(",") if x]
        assert [x for x in spans if x[0] != "model"] == [x.split(":") for x in names.split(",") if x] and len(spans) - len(want) == g.n_model
        assert all(0 <= int(a) < int(b) <= len(text[g.doc_id]) for _, a, b in spans)
    assert secrets.find_secrets(empty, net).count() == 0
    assert secrets.find_secrets(empty).count() == 0


def test_fit_writes_no_table(secret_rows):
    """The findings are read once; each file of a table starts processes (chmod) on an executor."""
    before = scratch.made()
    assert secrets.fit(secret_rows, 200).report["n"] > 0
    assert scratch.made() == before


@pytest.mark.parametrize("n", [0, 1, 6, 7, 763])
def test_network_tells_keys_from_words(n):
    """On findings that no part of the fit has seen, for any number of real ones."""
    r = np.random.default_rng(n)
    real, label = secrets.made_windows(secrets.made_findings(max(n, 2), ["anchor", "meadow", "copper"], seed=50))
    real, label = real[:n], np.where(r.random(n) < 0.02, 1, label[:n]).astype(np.float32)
    net = secrets.fitted(real, label, ["alpha", "model", "river", "stone", "paper"], 0.95)
    x, y = secrets.made_windows(secrets.made_findings(2000, ["winter", "table", "carpet", "lion", "orange"], seed=99))
    fresh = net.measure(x, y)
    assert net.report["recall"] >= 0.9 and net.report["precision"] >= 0.9 and 0.2 < net.report["positive"] / net.report["n"] < 0.8
    assert fresh["recall"] >= 0.9 and fresh["precision"] >= 0.85, fresh


def test_whole_candidates_are_read():
    net = secrets.fitted(np.zeros((0, secrets.WINDOW), np.uint8), np.zeros(0, np.float32), [], 0.95)
    key = "aZ3kQ9x71LmT0vB8rN5dW2yH"
    found = lambda t: next(secrets.scan(pa.array([t]), net))[2][0]
    for n in (0, 5, 60, 300):  # a key behind a path of any length
        path = "".join("stone/" for _ in range(n // 6))
        text = "é see " + path + key + " there"
        assert any(a <= text.index(key) + 12 <= b and k == 3 for a, b, k in found(text)), n
    assert found("no key here") == found("") == []
    lone = [(a, b) for a, b, k in found("ß " * 30 + key + " ß") if k == 3]
    assert lone == [(60, 60 + len(key))]


def test_many_findings_take_linear_time():
    net = secrets.fitted(np.zeros((0, secrets.WINDOW), np.uint8), np.zeros(0, np.float32), [], 0.95)
    r = random.Random(4)
    text = "\n".join("é " + "".join(r.choice("abcXYZ0189") for _ in range(32)) + (" secret=abcdef" if i % 2 else "") for i in range(20000))
    began = time.time()
    assert len(next(secrets.scan(pa.array([text]), net))[2][0]) > 25000 and time.time() - began < 60


def test_gradients():
    net, r = secrets.Network(), np.random.default_rng(1)
    x, y = r.integers(0, 97, (6, secrets.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: float(np.mean(np.log1p(np.exp(net.logits(x))) - y * net.logits(x)))
    got = net._gradients(x, y)
    for k in ("c", "w", "b", "o"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-4
        up = loss()
        net.p[k][at] -= 2e-4
        slope = (up - loss()) / 2e-4
        net.p[k][at] += 1e-4
        assert abs(slope - got[k][at]) < 1e-4


def test_label_model():
    """Votes of known voters, one of them many times over: their odds are found without a label, and copies count about once."""
    r = np.random.default_rng(3)
    y = r.random(4000) < 0.3
    right = [0.9, 0.8, 0.75, 0.7]
    lone = [np.where(r.random(4000) < p, y, ~y) for p in right]
    v = np.stack([np.where(x, 1, -1) for x in [*lone, *[lone[3]] * 6]], axis=1).astype(np.int8)
    post, told = toxicity.label_model(v)
    assert ((post > 0.5) == y).mean() > 0.86 > ((v.sum(axis=1) > 0) == y).mean()
    assert all(abs(told[2, j] - p) < 0.1 and abs(told[3, j] - p) < 0.1 for j, p in enumerate(right[:3]))


def test_label_model_memory():
    """12,000 rows with as many voters as there may be: the driver holds no float of each vote."""
    r = np.random.default_rng(4)
    y = r.random((toxicity.SAMPLE, 1)) < 0.3
    v = np.where(r.random((len(y), toxicity.TERMS + 20)) < np.where(y, 0.2, 0.02), 1, 0).astype(np.int8)
    tracemalloc.start()
    post, _ = toxicity.label_model(v, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((post > 0.5) == y[:, 0]).mean() > 0.99
    assert most < 8 * v.size


def labelled(spark, sf, run):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return run(docs, labels).join(labels, "doc_id").where("held_out").collect()


def area(score, y):
    rank = np.argsort(np.argsort(score)) + 1.0
    score, y = np.array(score), np.array(y)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_toxicity_held_out(spark, sf):
    rows = labelled(spark, sf.replace("0.001", "0.01"), toxicity.toxicity)
    assert area([r.score for r in rows], [r.toxic for r in rows]) > 0.85
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in rows]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_toxicity_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    lone = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(lone) == docs.count() and not any(r.predicted for r in lone)
    again = toxicity.toxicity(docs.withColumn("source", F.lit("q")).withColumn("lang", F.lit("q")), labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)


def test_quality_held_out(spark, sf):
    rows = labelled(spark, sf.replace("0.001", "0.01"), lambda d, k: quality.quality(d, k, F.col("source"), F.col("lang")))
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.3


def test_quality_by_hand(spark):
    """Site priors from evidence of given size, against plain Python."""
    r = random.Random(6)
    rows = [(i, r.choice(["h1", "h1", "h2", None]), r.choice(["p", "q", None]), r.gauss(1, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, llr double")
    prior = quality.global_prior(df)
    both, k_host, k_path = quality.sites(df, prior)
    q = [1 / (1 + np.exp(-(x + np.log(prior / (1 - prior))))) for *_, x in rows]
    assert abs(np.mean(q) - prior) < 0.02
    for s in both.collect():
        mine = [(h, p, v) for (_, h, p, _), v in zip(rows, q, strict=True) if h == s.host]
        assert s.host_n == len(mine) and abs(s.host_good - sum(v for *_, v in mine)) < 1e-6
        assert s.n == sum(p == s.path for _, p, _ in mine)
    assert k_host > 0 and k_path > 0


def test_quality_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    by = F.col("source"), F.col("lang")
    got = quality.quality(docs, labels, *by).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert quality.quality(empty, labels, *by).count() == 0
    assert all(r.kept and r.evidence == 0 for r in quality.quality(docs, labels.limit(0), *by).collect())


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrst"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(r.randrange(20, 70)))) for i in range(25)] + [(100, "short item of five"), (103, "of five"), (101, None), (None, "x y z"), (102, "")]
    docs, want = [], {}
    for i in range(120):
        body, hit = words(r.randrange(60, 300)), None
        if i % 3 == 0:
            hit = i % 25
            part = items[hit][1].split(" ")
            for _ in range(len(part) // 12):
                part[r.randrange(len(part) * 3 // 4)] = r.choice(vocabulary)
            at = r.randrange(len(body))
            body[at:at] = part
        docs.append((i, " ".join(body)))
        want[i] = hit
    docs += [(500, "so here is a Short item, of FIVE words"), (501, None), (502, ""), (None, items[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_decontamination(leaks):
    docs, benchmark, want = leaks
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert len(got) == docs.count()
    for i, hit in want.items():
        assert got[i].contaminated == (hit is not None), i
        if hit is not None:
            assert str(hit) in got[i].items.split(",")
    assert got[500].items == "100" and not got[501].contaminated and not got[502].contaminated and got[None].items == "3"


def test_decontamination_in_blocks(leaks, monkeypatch):
    docs, benchmark, _ = leaks
    whole = sorted((str(r.doc_id), r.items) for r in decontaminate.decontaminate(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 10)
    assert sorted((str(r.doc_id), r.items) for r in decontaminate.decontaminate(docs, benchmark).collect()) == whole


def test_decontamination_of_paraphrases(spark):
    """Against the longest common subsequence of every stretch: words changed, added and left out all over the item."""
    r = random.Random(21)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrst" for d in "aeiou"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([8, 11, 14, 15, 16, 20, 20, 24, 30, 31, 40, 46, 47, 59, 90, 120] * 2)]
    docs = []
    for i in range(200):
        part = items[i % len(items)][1].split(" ")
        for _ in range(r.randrange(len(part) // 10, len(part) // 3 + 1)):
            k = r.randrange(len(part) if i % 2 else len(part) // 2)  # half of them in the first half only
            part[k : k + r.choice([0, 1, 1, 1, 1])] = words(r.choice([0, 1, 1, 1, 1]))
        docs.append((i, " ".join([*words(r.randrange(50)), *part, *words(r.randrange(50))])))
    part = items[5][1].split(" ")
    part[:8:2] = words(4)
    docs.append((900, " ".join([*words(16), *part])))
    ids = {w: k for k, w in enumerate(vocabulary)}
    coded = lambda text: np.array([ids[w] for w in text.split(" ")])
    want = set()
    for d, text in docs:
        t = coded(text)
        for i, item in items:
            x = coded(item)
            if np.isin(x, t).mean() >= decontaminate.COMMON and any(decontaminate.confirmed(x, t[p : p + len(x) + 2 * (len(x) // 4)]) for p in range(len(t))):
                want.add((d, i))
    assert (900, 5) in want
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 80 and {(x.doc_id, int(i)) for x in found for i in x.items.split(",") if i} == want


def test_decontamination_inputs(docs, empty, leaks):
    assert decontaminate.decontaminate(docs, leaks[1].limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, leaks[1]).count() == 0
    assert decontaminate.decontaminate(docs, leaks[1]).count() == docs.count()


def test_common_length():
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = r.integers(0, 5, r.integers(0, 30)), r.integers(0, 5, r.integers(0, 30))
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
            row = new
        assert common_length(x, y) == row[-1]
