"""Near and exact copies, and lines, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lumenforge.llm import exact_dedup, lines, near_dedup, textscan, tiles
from lumenforge.llm.common import read
from lumenforge.llm.minhash import superminhash
from lumenforge.llm.queries import ORACLES, QUERIES


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, width):
    rows = docs.select("doc_id", "text").collect()
    named = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda x: x[0])
    sets = [shingle_set(t, width) for _, t in named]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i]) and bool(sets[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    root = components(len(named), linked)
    want = {named[i][0]: (len(sets[i]), named[root[i]][0]) for i in range(len(named))}
    got = near_dedup.near_dedup(docs, width, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_dedup_of_a_large_group(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(900):  # many tiles around few centres
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(60)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t, 2) for _, t in rows]
    root = components(900, lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == dict(enumerate(root))


def test_tiles_with_many_open_members(spark):
    """Numbers are linked where they differ by one: few of them with their centre, so nearly all stay open."""
    r = random.Random(9)
    values = {i: v for i, v in enumerate(r.sample(range(4000), 1500))}

    def tester(raw):
        v = np.array([int(x) for x in raw])
        return lambda p, apart: np.flatnonzero(apart & (np.abs(v - v[p]) == 1))

    near = spark.createDataFrame([(0, i) for i in values if i], "centre long, id long")
    own = spark.createDataFrame([(i, str(v).encode()) for i, v in values.items()], "id long, payload binary")
    got = tiles.links(near, lambda ids: own.join(ids, "id"), tester).collect()
    assert all(abs(values[x.a] - values[x.b]) == 1 for x in got)
    want = components(1500, lambda i, j: abs(values[i] - values[j]) == 1)
    pairs = {(x.a, x.b) for x in got} | {(x.b, x.a) for x in got}
    assert components(1500, lambda i, j: (i, j) in pairs) == want


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sig = superminhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 160)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.12


def test_exact_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    assert len(rows) > len({r.doc_id for r in rows})
    for g in exact_dedup.exact_dedup(docs).join(docs.select("doc_id").distinct(), "doc_id").collect():
        text = next(r.text for r in rows if r.doc_id == g.doc_id)
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[bare], key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert (g.keep_id, g.group_size) == (best.doc_id, len(groups[bare])) and g.kept <= (g.doc_id == best.doc_id)
        assert g.text_sha256 == hashlib.sha256(bare.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs).count() == len(rows)
    assert exact_dedup.exact_dedup(docs).where("kept").count() == len(groups)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    mine = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(map(str, (tuple(r[x] for x in columns) for r in mine.collect()))) == sorted(str(tuple(r)) for r in found.fetchall())


def plain_lines(text):
    norm = lambda x: re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    return [norm(x) for x in text.split("\n")] if text else []


def common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def prints(texts, known):
    """SimHash and keys of normalised lines."""
    ends = np.cumsum([len(x.encode()) + 1 for x in texts]) - 1
    starts = ends - [len(x.encode()) for x in texts]
    words, n = lines.line_words(np.frombuffer("\n".join(texts).encode(), np.uint8), starts, ends)
    keys, many = lines.block_keys(words, n, known.common)
    sims, shape = lines.simhashes(words, n, known.mean), np.array([len(x) for x in texts]) << 32 | n
    return lambda i: lines.within_reach(sims, sims[i], shape, shape[i]), [set(x.tolist()) for x in np.split(keys, np.cumsum(many)[:-1])]


@pytest.mark.parametrize("bucket", [3, 4096])
def test_fuzzy_lines(spark, bucket):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    pool = [" ".join(r.choice(words) for _ in range(r.randrange(5, 60))) for _ in range(14)]
    rows = [(100, None), (101, ""), (102, "short\n\nshort")]
    for i in range(40):
        some = []
        for _ in range(r.randrange(1, 5)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice("xyz ")
            some.append("".join(x) if r.random() < 0.8 else "".join(x).upper() + " !")
        rows.append((i, "\n".join(some)))
    rows += [rows[-1], (None, pool[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = lines.statistics(docs)
    places = [(d is None, d or 0, no, x) for d, t in rows for no, x in enumerate(plain_lines(t)) if len(x) >= 20]
    texts = sorted({x for *_, x in places})
    reach, blocks = prints(texts, known)

    def near(i, j):
        return 2 * common(texts[i], texts[j]) >= 0.9 * (len(texts[i]) + len(texts[j]))

    def linked(i, j):
        return reach(i)[j] and not blocks[i].isdisjoint(blocks[j]) and near(i, j)

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)]
    assert np.mean([linked(i, j) for i, j in pairs]) > 0.85
    if bucket == 3:  # blocks of single windows are cut by second ones, which most near lines share too
        pairs_of = lambda x: {frozenset((p, q)) for p in x for q in x if p != q or len(x) == 1}
        many = Counter(k for x in blocks for k in x)
        blocks = [{k for k in x if many[k] <= 3} | {p for p in pairs_of(x) if any(many[k] > 3 for k in p)} for x in blocks]
        assert np.mean([linked(i, j) for i, j in pairs]) > 0.8

    root = dict(zip(texts, components(len(texts), linked), strict=True))
    assert len(set(root.values())) < len(texts)
    assert np.mean([root[texts[i]] == root[texts[j]] for i, j in pairs]) > (0.98 if bucket > 3 else 0.95)
    first = {}
    for p in sorted(places):
        first.setdefault(root[p[3]], p[:3])
    want = sorted((d is None, d or 0, len(plain_lines(t)), ",".join(str(no) for no, x in enumerate(plain_lines(t)) if len(x) >= 20 and first[root[x]] != (d is None, d or 0, no))) for d, t in rows)
    found = lines.fuzzy_lines(docs, bucket=bucket)
    got = sorted((g.doc_id is None, g.doc_id or 0, g.n_lines, g.dropped) for g in found.collect())
    drops = lambda rows: Counter((u, d, no) for u, d, _, x in rows for no in x.split(",") if no)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    # Two lines apart from their centre may be near each other and not be compared: groups can be finer, never coarser.
    assert not drops(got) - drops(want) and drops(got).total() >= 0.97 * drops(want).total()
    kept = {x.doc_id: x.text for x in lines.drop_lines(docs, found).collect()}
    assert kept[102] == "short\n\nshort" and kept[100] is None


def test_large_blocks_lose_no_pair(spark):
    """Lines that share one window only, in a block larger than a bucket: each two that may be similar meet in a group."""
    r = random.Random(6)
    n = 150
    kinds = np.array([[r.randrange(0, 3) for _ in range(16)] for _ in range(n)], dtype=np.uint8)
    sims = np.array([sum(1 << b for b in r.sample(range(64), 9)) for _ in range(n)], dtype=np.uint64)  # no two are more than 18 bits apart
    shape = np.full(n, (100 << 32) | 5)
    low, high = kinds.view(np.int64).T
    rows = [(i, int(sims[i].view(np.int64)), int(shape[i]), int(low[i]), int(high[i]), [7, 1000 + i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, sim long, shape long, low long, high long, keys array<long>").repartition(3)
    want = {(i, j) for i in range(n) for j in range(i) if np.abs(kinds[i].astype(int) - kinds[j]).sum() <= 20}
    assert 1000 < len(want)
    for bucket in (16, 64, 4096):
        groups = defaultdict(set)
        for x in lines.close_lines(df, bucket=bucket).collect():
            groups[x.centre] |= {x.centre, x.id}
        assert want <= {(i, j) for g in groups.values() for i in g for j in g}, bucket


def test_bounds_of_similarity():
    """The bounds decide as the longest common subsequence does."""
    r = random.Random(8)
    for _ in range(400):
        x = "".join(r.choice("abcde fgé国") for _ in range(r.randrange(20, 90)))
        y = list(x)
        for _ in range(r.randrange(0, 9)):
            y.insert(r.randrange(len(y)), r.choice("abc xyz")) if r.random() < 0.5 else y.pop(r.randrange(len(y)))
        y = "".join(y)
        assert lines.similar_texts(x, y, 0.9) == (2 * common(x, y) / (len(x) + len(y)) >= 0.9)
        assert lines._lost(x, y, 1000) >= len(x) + len(y) - 2 * common(x, y)


def test_unlike_lines_stop_early():
    """The longest common subsequence goes no further than it takes to see that it is too short, and its bound is one."""
    r = np.random.default_rng(6)
    for _ in range(60):
        x, y = r.integers(0, 3, r.integers(1, 120)), r.integers(0, 3, r.integers(1, 120))
        real = textscan.common_length(x, y)
        for least in (0, 1, real, real + 1, real + 20):
            got = textscan.common_length(x, y, least)
            assert got == real if real >= least else real <= got < least
    x, y = ("".join(r.choice(["a", "b"], 20_000)) for _ in range(2))
    began = time.process_time()
    textscan.common_length(lines._codes(x), lines._codes(y))
    whole = time.process_time() - began
    began = time.process_time()
    assert not lines.similar_texts(x, y, 0.9)
    assert time.process_time() - began < 0.8 * whole


def test_many_common_lengths():
    """Longest common subsequences of many pairs at once are those of single pairs, or bounds under what is asked for."""
    r = np.random.default_rng(7)
    for kinds, longest in ((2, 40), (5, 130), (64, 300), (3, 700)):
        xs, ys = ([r.integers(0, kinds, r.integers(1, longest)).astype(np.uint8) for _ in range(60)] for _ in range(2))
        ys[:20] = [np.delete(x, r.integers(0, len(x), len(x) // 9)) if len(x) > 9 else x for x in xs[:20]]
        real = np.array([textscan.common_length(x, y) for x, y in zip(xs, ys, strict=True)])
        for least in (np.zeros(60, np.int64), real, real + 1, real + 30):
            got = textscan.common_lengths(xs, ys, least)
            assert (got >= real).all() and (got[real >= least] == real[real >= least]).all() and (got[real < least] < least[real < least]).all()


@pytest.mark.parametrize("letters", ["abcde fghi", "".join(chr(0x4E00 + i) for i in range(300))])
def test_pairs_together(monkeypatch, letters):
    """Pairs that bounds don't decide are decided as one by one, without a run through the letters of each; with more than 64 kinds, too."""
    r = random.Random(12)
    pairs = []
    for k in range(300):
        x = [r.choice(letters) for _ in range(r.randrange(20, 400))]
        y = [c if r.random() < 0.8 + 0.2 * (k % 3 > 0) - 0.1 * (k % 3 > 1) else r.choice(letters) for c in x]
        pairs.append(("".join(x), "".join(y)))
    want = [2 * textscan.common_length(lines._codes(x), lines._codes(y)) / (len(x) + len(y)) >= 0.9 for x, y in pairs]
    assert 50 < sum(want) < 250
    alone = []
    monkeypatch.setattr(lines, "common_length", lambda *a: alone.append(1) or textscan.common_length(*a))
    for far in (None, [k % 2 == 0 for k in range(300)]):
        del alone[:]
        assert lines.similar_pairs(pairs, 0.9, far).tolist() == want
        assert len(letters) > 64 or len(alone) < 100


def test_tiles_together(spark):
    """Pairs tested many tiles at a time join what is linked, also where nearly all members stay open."""
    r = random.Random(9)
    values = {i: v for i, v in enumerate(r.sample(range(4000), 1500))}
    asked = Counter()

    def pairs(raw):
        v = np.array([int(x) for x in raw])

        def linked(i, j):
            asked.update(zip(i.tolist(), j.tolist(), strict=True))
            return np.abs(v[i] - v[j]) == 1

        return linked

    near = spark.createDataFrame([(c, i) for c in (0, 700) for i in values if i != c], "centre long, id long")
    own = spark.createDataFrame([(i, str(v).encode()) for i, v in values.items()], "id long, payload binary")
    got = tiles.links(near, lambda ids: own.join(ids, "id"), None, pairs).collect()
    assert all(abs(values[x.a] - values[x.b]) == 1 for x in got)
    both = {(x.a, x.b) for x in got} | {(x.b, x.a) for x in got}
    want = components(1500, lambda i, j: abs(values[i] - values[j]) == 1)
    assert components(1500, lambda i, j: (i, j) in both) == want
    held = []
    for k in range(40):
        held.append(tiles._Tile(k * 100, None, pairs))
        held[-1].add([k * 100 + i for i in range(k % 5 + 1)], [str(k * 100 + i // 2 * 7 + i % 2).encode() for i in range(k % 5 + 1)], False)
    found = tiles._finish_together(held, pairs)
    assert {(a, b) for a, b, is_open in found if not is_open} == {(k * 100 + i, k * 100 + i + 1) for k in range(40) for i in (0, 2) if i + 1 <= k % 5}
    assert {(a, b) for a, b, is_open in found if is_open} == {(k * 100, k * 100 + i) for k in range(40) for i in range(2, k % 5 + 1)}
    assert max(asked.values()) == 1  # no pair twice


def test_groups_of_lines_of_many_lengths():
    """In a large bucket any two lines that aren't ruled out are in one group, whatever their lengths."""
    r = np.random.default_rng(3)
    n = 300
    shape = (r.integers(20, 300, n) << 32) | r.integers(1, 70, n)
    sims = np.packbits(r.random((n, 64)) < 0.15, axis=1).view(np.uint64).ravel()
    some = lines._Lines(sims, shape, r.integers(0, 3, (n, 16)).astype(np.uint8))
    i, j = np.triu_indices(n, 1)
    keep = some.near(i, j, 0.9)
    groups = defaultdict(set)
    for c, q in lines.near_stars(some, 0.9):
        groups[c] |= {c, q}
    assert len(keep) > 300
    assert all(any({p, q} <= g for g in groups.values()) for p, q in zip(i[keep].tolist(), j[keep].tolist(), strict=True))
    assert all(len(some.near(np.array([c]), np.array([q]), 0.9)) for c, q in lines.near_stars(some, 0.9))


def test_classes_of_lines(spark):
    """First places and numbers of the lines that are there again or near another one; null ids last, rows of one id by line number and hash."""
    r = random.Random(4)
    rows = [(r.choice([None, *range(-9, 40)]), r.randrange(-(2**63), 2**63), [r.randrange(300) for _ in range(r.randrange(0, 9))]) for _ in range(120)]
    df = spark.createDataFrame([(d, h, len(x), list(range(len(x))), x) for d, h, x in rows], "doc_id long, h long, n_lines int, no array<int>, id array<long>")
    near = spark.createDataFrame([(0, 5), (0, 7), (20, 7), (999, 1000)], "centre long, id long")
    places = defaultdict(list)
    for d, h, x in rows:
        for no, i in enumerate(x):
            places[i].append((d is None, d or 0, no, h))
    want = {i: (min(p), len(p)) for i, p in places.items() if len(p) > 1 or i in (0, 5, 7, 20)}
    got = {}
    for x in lines.line_classes(df.repartition(7), near).collect():
        if x.id not in (999, 1000):
            got[x.id] = ((x.first.unnamed, x.first.doc_id or 0, x.first.no, x.first.h), x.n)
            assert x.first.unnamed == (x.first.doc_id is None)
    assert got == want


def test_short_lines(spark, tmp_path):
    """The query drops repeats of short lines; empty lines stay."""
    long = "a line that is long enough to be compared nearly"
    rows = [(2, f"Read more\n\nyes\n{long}"), (1, f"read more!\n{long}\n\nno"), (3, "YES\nread  more\n---\nmore"), (4, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.n_lines, x.dropped) for x in QUERIES["op5_fuzzy_lines"](spark, str(tmp_path)).collect())
    assert got == [(1, 4, ""), (2, 4, "0,3"), (3, 4, "0,1"), (4, 0, ""), (4, 0, "")]


@pytest.mark.parametrize("n_words", [4, 6, 10, 16, 25, 29, 60, 200])
def test_recall_of_changed_lines(n_words):
    """Lines of every length with a letter, a word or three words changed, as long as they stay similar enough, mostly share a block and are within reach."""
    r = random.Random(n_words)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(n_words)) for _ in range(300)]
    known = lines.Statistics(np.full(64, 0.5), np.zeros(1 << 16, dtype=bool))
    for kind in ("letter", "word", "words", "added"):
        changed = []
        for x in texts:
            w = x.split(" ")
            for _ in range(3 if kind == "words" else 1):
                k = r.randrange(n_words)
                w[k] = w[k][:-1] + "q" if kind == "letter" else r.choice(words) + (" " + w[k] if kind == "added" else "")
            changed.append(" ".join(w))
        reach, keys = prints(texts + changed, known)
        similar = [lines.similarity(np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)) >= 0.9 for x, y in zip(texts, changed, strict=True)]
        found = [reach(i)[i + 300] and bool(keys[i] & keys[i + 300]) for i in range(300)]
        if sum(similar) >= 30:
            assert np.mean([f for f, s in zip(found, similar, strict=True) if s]) >= 0.95, (kind, n_words)


def test_words_end_with_their_line():
    """A line has the same words wherever it stands, also at the end of a text before one whose first line isn't looked at."""
    first, line = "unlike the other lines of this text", "a line that stands at the end of a text"
    found = []
    for texts in ([f"{first}\n{line}"], [f"{line}\n{first}"], [line, "short"], [line, f"short\n{first}"]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        m, starts, ends, _ = lines.normalised(data, np.cumsum([0, *(len(x) for x in texts)]))
        some = [i for i in lines._long(m, starts, ends) if m[starts[i] : ends[i]].tobytes() == line.encode()]
        words, n = lines.line_words(m, starts[some], ends[some])
        assert n.tolist() == [10]
        found.append(words.tolist())
    assert all(x == found[0] for x in found)


def test_packed_lines_make_the_same_groups():
    """Lines and keys go to the buckets in one row a part; the groups are those of lines sorted by key, repeated lines or not."""
    r = np.random.default_rng(9)
    n = 3000
    ids = r.integers(0, 2000, n)  # a third is there again
    sims = (np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64)).view(np.int64)
    rows = np.stack([ids, sims[ids], np.full(n, (100 << 32) | 30), np.zeros(n, np.int64), np.zeros(n, np.int64), ids * 7 - 5000])
    keys = [[int(i % 400) - 200, 1 << 40 | int(i)] for i in ids]
    batches = [pa.RecordBatch.from_arrays([*(pa.array(x[a : a + 700]) for x in rows), pa.array(keys[a : a + 700], pa.list_(pa.int64()))], ["id", "sim", "shape", "low", "high", "spread", "keys"]) for a in range(0, n, 700)]
    none = np.zeros(0, np.int64)
    packed = list(lines._packed(16, none, none)(iter(batches)))
    assert sum(len(x) for x in packed) == 16
    assert sum(len(x) for b in packed for x in b.column("lines").to_pylist()) == 48 * 2 * n
    whole = pa.Table.from_batches(packed).sort_by("part").combine_chunks()
    groups = lambda found: {x for b in found for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    got = groups(lines._packed_buckets(0.9)(iter(whole.to_batches(max_chunksize=3))))
    each = np.concatenate([np.concatenate([[[k] for k in keys[i]], np.repeat(rows[None, :5, i], 2, axis=0)], axis=1) for i in range(n)]).T
    each = each[:, np.lexsort((each[1], each[0]))]
    want = groups(lines._buckets(0.9)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in each], list("abcdef"))])))
    assert len(want) > 1000 and got == want


def test_letters_bound_the_similarity():
    """No pair that is similar is ruled out."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdé 0国") for _ in range(r.randrange(20, 60))) for _ in range(60)]
    texts += ["".join(c if r.random() < 0.95 else r.choice("ab") for c in x) for x in texts]
    ends = np.cumsum([len(x.encode()) + 1 for x in texts]) - 1
    found = lines.letters(np.frombuffer("\n".join(texts).encode(), np.uint8), ends - [len(x.encode()) for x in texts], ends).astype(int)
    for i, x in enumerate(texts):
        assert found[i].sum() == len(x)
        for j, y in enumerate(texts[:i]):
            assert np.abs(found[i] - found[j]).sum() <= len(x) + len(y) - 2 * common(x, y)


def test_texts_without_spaces():
    """Changes move cuts near them only."""
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(60)) for _ in range(200)]
    changed = [x[:k] + "国" + x[k + 1 :] for x in texts for k in [r.randrange(60)]]
    known = lines.Statistics(np.full(64, 0.5), np.zeros(1 << 16, dtype=bool))
    reach, keys = prints(texts + changed, known)
    assert np.mean([reach(i)[i + 200] and bool(keys[i] & keys[i + 200]) for i in range(200)]) > 0.95


@pytest.mark.parametrize("run", [near_dedup.near_dedup, exact_dedup.exact_dedup, lines.fuzzy_lines])
def test_empty_and_awkward(docs, empty, run):
    assert run(empty).count() == 0
    assert run(docs).count() == docs.count()


def test_read_ships_the_package(spark, sf):
    assert read(spark, sf, "labels").count() > 0
