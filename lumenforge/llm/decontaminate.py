"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of word hashes (letters and digits, lower case), written once.
2. Passages of 32 words over all documents give passage frequencies, then the randomised SVD
   of their TF-IDF matrix A (hashed to ``DIM`` columns): every partition adds up its part of
   A'(A*Omega), the parts are summed in a tree, and the range found gives the singular vectors in
   one pass over the passages. Latent coordinates are scaled by the singular values, so
   that what all texts of a language share doesn't hide what sets passages apart.
3. An item is indexed by its windows at several offsets; the window is short enough that
   any copy of the item contains one whole window of the document's own grid. All windows of
   all documents are compared with the index, in blocks, by cosine.
4. The latent index alone misses copies with scattered changes. So items are sought by their rarest words as
   well: of a copy that ``COMMON`` accepts at most ``1 - COMMON`` of the item's words are missing, hence of that many
   words and ``least`` more at least ``least`` stand in one stretch. That loses no copy.
5. A candidate place is confirmed by the longest common subsequence of the item and the words
   around the place, and by its answer: the end of the item must be there as well.
   Items under ``PROJECTED`` words have too little to project and are sought by their rarest words alone; those under ``SHORT``
   words, of which chance makes copies, as exact sequences; those under ``LEAST`` words are not sought, as every text has them.

Nothing about documents reaches the driver but ``DIM`` counts and a ``DIM`` by ``WIDE`` matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .common import mark
from .textscan import chunks, common_length, words

DIM, PASSAGE, RANK, WIDE, BLOCK_ROWS = 8192, 32, 24, 28, 256
PROJECTED, SHORT, LEAST, COSINE, COMMON, ANSWER = 15, 8, 3, 0.8, 0.7, 0.5
ITEMS = 4096
#: The most pairs of a word and an item that are looked at together.
PAIRS = 1 << 20
_CHAR = np.zeros(256, dtype=bool)
_CHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the row's doc_id and text) and the 32-bit hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text"), lower=True):
                hashed, first = words(data, offsets, lower=False, table=_CHAR)
                t = (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                raw = [t[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("doc_id", "mark")), pa.array(raw, pa.binary())], ["doc_id", "mark", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), mark().alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, tokens binary")


def _flat(raw: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end, tokens, place of each row's first token and one more)."""
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 21), "right")) - 1)
        yield a, b, np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), dtype=np.uint32), (offsets[a : b + 1] - offsets[a]) // 4
        a = b


def _windows(first: np.ndarray, width: int, part: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of each window of a grid that begins anew in each row; ``part``: shorter ones at the end as well."""
    n = np.diff(first)
    many = -(-n // width) if part else n // width
    row = np.repeat(np.arange(len(n)), many)
    return first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * width, row


def _passages(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The distinct buckets of each passage, one passage a row; DIM fills the rows up."""
    starts, row = _windows(first, PASSAGE, True)
    if not len(starts):
        return np.zeros((0, PASSAGE), np.uint16)
    at = starts[:, None] + np.arange(PASSAGE)
    inside = at < first[1:][row][:, None]
    b = np.where(inside, (t[np.minimum(at, len(t) - 1)] & np.uint32(DIM - 1)).astype(np.uint16), np.uint16(DIM))
    b.sort(axis=1)
    again = b[:, 1:] == b[:, :-1]
    b[:, 1:][again] = DIM
    return b


def scatter_sum(total: np.ndarray, bucket: np.ndarray, of: np.ndarray, y: np.ndarray, group: int = 16) -> None:
    """``total[bucket[i]] += y[of[i]]`` for all i. Rows of one bucket are first added up in groups, which numpy does much faster."""
    order = np.argsort(bucket, kind="stable")
    n = np.bincount(bucket, minlength=len(total))
    groups = -(-n // group)
    place = np.arange(len(order)) + np.repeat((np.cumsum(groups) - groups) * group - (np.cumsum(n) - n), n)
    at = np.full(int(groups.sum()) * group, len(y))
    at[place] = of[order]
    some = np.einsum("gkc->gc", np.take(np.concatenate([y, np.zeros((1, y.shape[1]), y.dtype)]), at, axis=0).reshape(-1, group, y.shape[1]))
    used = np.flatnonzero(groups)
    total[used] += np.add.reduceat(some, (np.cumsum(groups) - groups)[used], axis=0)


def passage_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for _, _, t, first in _flat(batch.column("tokens")):
                b = _passages(t, first)
                total += np.bincount(b.ravel(), minlength=DIM + 1)[:DIM]
                n += len(b)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    got = rows.select("tokens").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, passages = np.zeros(DIM), 0
    for r in got:
        if r["bucket"] < 0:
            passages = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, passages


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in pdf["part"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "node": [pdf["node"].iloc[0] // 16], "part": [total.astype(np.float32).tobytes()]})


def sketch(rows: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'(A * omega) over the passages of all rows, summed up a tree of fan-in 16 with one root, whatever the number of partitions."""
    weighted = np.concatenate([omega * idf[:, None], np.zeros((1, WIDE))]).astype(np.float32)
    square = np.append(idf**2, 0).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, WIDE))
        for batch in batches:
            for _, _, t, first in _flat(batch.column("tokens")):
                b = _passages(t, first)
                if not len(b):
                    continue
                norm = np.maximum(np.take(square, b).sum(axis=1), 1e-9)
                y = np.einsum("pkc->pc", np.take(weighted, b, axis=0)) / norm[:, None]
                real = np.flatnonzero(b.ravel() < DIM)
                scatter_sum(total, b.ravel()[real], real // PASSAGE, y)
        total *= idf[:, None]
        parts = [total[i : i + BLOCK_ROWS].astype(np.float32).tobytes() for i in range(0, DIM, BLOCK_ROWS)]
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([node] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "node", "part"])

    kind = "block long, node long, part binary"
    parts = rows.select("tokens").mapInArrow(run, kind)
    parts = parts.withColumn("node", F.expr("node div 16"))
    for _ in range(max(1, math.ceil(math.log(max(rows.rdd.getNumPartitions(), 1), 16)))):
        parts = parts.groupBy("block", "node").applyInPandas(_sum_blocks, kind)
    out = np.zeros((DIM, WIDE))
    for r in parts.collect():
        i = r["block"] * BLOCK_ROWS
        out[i : i + BLOCK_ROWS] += np.frombuffer(r["part"], dtype=np.float32).reshape(-1, WIDE)
    return out


def latent_basis(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Latent coordinates of each bucket (DIM by RANK), IDF and scaling included, and the passages that have it."""
    found, passages = passage_frequencies(rows)
    idf = np.log((passages + 1) / (found + 1)) + 0.1
    omega = np.random.default_rng(7).standard_normal((DIM, WIDE))
    z = sketch(rows, idf, omega)
    q, _ = np.linalg.qr(z)
    small = (q.T @ z) @ np.linalg.pinv(q.T @ omega)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value)[:RANK]
    sigma = np.sqrt(np.maximum(value[best], 1e-9 * max(value.max(), 1e-9)))
    return ((q @ vector[:, best]) / sigma * idf[:, None] * sigma.mean()).astype(np.float32), found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _width(n: int) -> int:
    return 24 if n >= 47 else 16 if n >= 31 else 8


def _need(n: int) -> int:
    """The fewest words of an item of n words that are a share of COMMON."""
    return int(np.ceil(COMMON * n - 1e-9))


def _reach(n: int) -> int:
    """Words of the stretch in which an item of n words is sought."""
    return n + 2 * (n // 4)


class Index:
    """Items of a benchmark block, ready to be sought."""

    def __init__(self, ids: list[int], items: list[np.ndarray], basis: np.ndarray, common: np.ndarray) -> None:
        self.ids, self.items, self.basis = ids, items, basis
        self.scales: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        entries: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(items):
            if len(t) >= PROJECTED:
                w = _width(len(t))
                entries.setdefault(w, []).extend((i, o) for o in range(0, w, w // 8))
        self.around: dict[int, np.ndarray] = {}
        for w, found in entries.items():
            self.around[w] = np.stack([items[i][np.clip(np.arange(o - 2, o + w + 2), 0, len(items[i]) - 1)] for i, o in found])
            x = np.stack([basis[items[i][o : o + w] & np.uint32(DIM - 1)].sum(axis=0) for i, o in found])
            self.scales[w] = (_unit(x).T.astype(np.float32), np.array([i for i, _ in found]), np.array([o for _, o in found]))
        self._seed(common)
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, t in enumerate(items):
            if LEAST <= len(t) < SHORT:
                self.short.setdefault(len(t), {}).setdefault(t.tobytes(), []).append(i)

    def _seed(self, common: np.ndarray) -> None:
        """The rarest words of each item, and how many of them a copy has at least. common: how common each bucket is."""
        size = np.array([len(t) for t in self.items], dtype=np.int64)
        self.least, self.reach = 1 + size // 10, size + 2 * (size // 4)
        words, of = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, t in enumerate(self.items):
            if len(t) >= SHORT:
                order = np.lexsort((t, common[t & np.uint32(DIM - 1)]))
                words.append(np.unique(t[order[: len(t) - _need(len(t)) + self.least[i]]]))
                of.append(np.full(len(words[-1]), i))
        word, of = np.concatenate(words), np.concatenate(of)
        order = np.argsort(word, kind="stable")
        self.posting = of[order]
        self.words, self.begin, self.many = np.unique(word[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.words & np.uint32(0xFFFF)] = True

    def seeded(self, t: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, and begin and end of each stretch of words in which the item may stand; together they hold every copy."""
        at = np.flatnonzero(self.maybe[t & np.uint32(0xFFFF)])
        if not len(self.words) or not len(at):
            return
        k = np.minimum(np.searchsorted(self.words, t[at]), len(self.words) - 1)
        real = self.words[k] == t[at]
        at, k = at[real], k[real]
        sums = np.concatenate([[0], np.cumsum(self.many[k])])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(sums, sums[a] + PAIRS, "right")) - 1)
            # Those that begin before b; their stretches may reach further.
            end = len(at) if b >= len(at) else int(np.searchsorted(at, at[b - 1] + self.reach.max()))
            n = self.many[k[a:end]]
            item = self.posting[np.repeat(self.begin[k[a:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            nth = np.repeat(np.arange(a, end), n)
            order = np.argsort(item, kind="stable")
            item, nth = item[order], nth[order]
            place = at[nth]
            row = np.searchsorted(first, place, "right") - 1
            last = np.arange(len(item)) + self.least[item] - 1
            some = np.flatnonzero((nth < b) & (last < len(item)))
            last = last[some]
            some = some[(item[last] == item[some]) & (row[last] == row[some]) & (place[last] - place[some] < self.reach[item[some]])]
            now = None
            for r, i, p in zip(row[some].tolist(), item[some].tolist(), place[some].tolist(), strict=True):
                reach = int(self.reach[i])
                low, high = max(int(first[r]), p - reach + 1), min(int(first[r + 1]), p + reach)
                if now and now[:2] == (r, i) and low <= now[3]:
                    now = (r, i, now[2], high)
                    continue
                if now:
                    yield now
                now = (r, i, low, high)
            if now:
                yield now
            a = b

    def candidates(self, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and places in t where the item would begin. Three fifths of the window's words must be in the item's window or beside it."""
        starts, row = _windows(first, 8, False)
        rows, items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(starts) and self.scales:
            eight = np.einsum("pkc->pc", np.take(self.basis, t[starts[:, None] + np.arange(8)] & np.uint32(DIM - 1), axis=0))
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            for w, (index, item, offset) in self.scales.items():
                k = w // 8
                whole = np.flatnonzero(nth % k == 0)
                whole = whole[whole + k <= len(row)]
                whole = whole[row[whole + k - 1] == row[whole]]
                x = _unit(sum(eight[whole + j] for j in range(k)))
                for a in range(0, len(x), 512):
                    n, m = np.divmod(np.flatnonzero((x[a : a + 512] @ index).ravel() > COSINE), len(item))
                    at = starts[whole[a + n]]
                    same = t[at[:, None] + np.arange(w)][:, :, None] == self.around[w][m][:, None, :]
                    some = same.any(axis=2).sum(axis=1) * 5 >= 3 * w
                    n, m, at = n[some], m[some], at[some]
                    rows.append(row[whole[a + n]])
                    items.append(item[m])
                    places.append(at - offset[m])
        return np.concatenate(rows), np.concatenate(items), np.concatenate(places)

    def exact_short(self, t: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        for n, sought in self.short.items():
            heads = np.unique(np.array([np.frombuffer(k, dtype=np.uint32)[0] for k in sought], dtype=np.uint32))
            at = np.flatnonzero(np.isin(t, heads))
            row = np.searchsorted(first, at, "right") - 1
            for p, r in zip(at.tolist(), row.tolist(), strict=True):
                if p + n <= first[r + 1]:
                    for i in sought.get(t[p : p + n].tobytes(), ()):
                        yield r, i


def confirmed(item: np.ndarray, near: np.ndarray) -> float:
    """Share of the item that the text has in order, or 0 if it isn't enough or the answer isn't there."""
    n = len(item)
    if np.isin(item, near).sum() < COMMON * n:
        return 0.0
    share = common_length(item, near) / n
    answer = item[-max(3, n // 5) :]
    return share if share >= COMMON and common_length(answer, near) >= ANSWER * len(answer) else 0.0


def contained(item: np.ndarray, near: np.ndarray) -> float:
    """Share of the item in the first stretch that is confirmed, or in those after it while it grows; 0 if none is."""
    need, reach, best = _need(len(item)), _reach(len(item)), 0.0
    at = np.flatnonzero(np.isin(near, item))
    begin = at[: max(0, len(at) - need + 1)]
    for p in begin[at[need - 1 :] - begin < reach].tolist():
        share = confirmed(item, near[p : p + reach])
        if share < best or share == 1:
            return max(share, best)
        best = share
    return best


def search(rows: DataFrame, index: Index) -> DataFrame:
    """doc_id, mark, row (number of the written row), items (by commas), share (the best one) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t, first in _flat(batch.column("tokens")):
                found: list[dict[int, float]] = [{} for _ in range(b - a)]
                tried = set()
                for r, i, p in zip(*(x.tolist() for x in index.candidates(t, first)), strict=True):
                    if found[r].get(i) or (r, i, p // 4) in tried:
                        continue
                    tried.add((r, i, p // 4))
                    n = len(index.items[i])
                    if share := confirmed(index.items[i], t[max(first[r], p - n // 4) : min(first[r + 1], p + n + n // 4)]):
                        found[r][i] = share
                for r, i, low, high in index.seeded(t, first):
                    if not found[r].get(i) and (share := contained(index.items[i], t[low:high])):
                        found[r][i] = share
                for r, i in index.exact_short(t, first):
                    found[r][i] = 1.0
                items = [",".join(map(str, sorted(index.ids[i] for i in x))) for x in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("doc_id", "mark", "row")), pa.array(items, pa.string()), pa.array([max(x.values(), default=0.0) for x in found], pa.float64())], ["doc_id", "mark", "row", "items", "share"])

    return rows.mapInArrow(run, "doc_id long, mark long, row string, items string, share double")


def joined(blocks: list[DataFrame]) -> DataFrame:
    """What the blocks of a large benchmark found, together by row."""
    found = blocks[0]
    for x in blocks[1:]:
        found = found.unionByName(x)
    every = F.array_join(F.transform(F.array_sort(F.transform(F.filter(F.flatten(F.collect_list(F.split("items", ","))), lambda x: x != ""), lambda x: x.cast("long"))), lambda x: x.cast("string")), ",")
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), every.alias("items"), F.max("share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which documents contain items of the benchmark, also with some of the words changed.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns one row per row of docs:
    doc_id, mark (see there), contaminated, items (identifiers by commas, in order), share (of the item found best, 0 to 1).
    Null and empty texts contain nothing; items of fewer than three words or without identifier are not sought. Rows that repeat a
    doc_id are judged by their own text. An empty benchmark leaves everything clean.
    The benchmark is the query set: it is taken in blocks of ``ITEMS`` items, each compared with all rows.
    """
    rows = scratch.table(tokens(docs).withColumn("row", F.uuid()), "tokens", "zstd")
    sought = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").alias("doc_id"), "text")
    sought = scratch.table(tokens(sought).dropDuplicates(["doc_id", "tokens"]), "items").orderBy("doc_id", "tokens")
    basis, common, block, out = None, np.zeros(DIM), [], []
    for r in sought.toLocalIterator():
        block.append((r["doc_id"], np.frombuffer(bytes(r["tokens"]), dtype=np.uint32)))
        if len(block) == ITEMS:
            basis, common = latent_basis(rows) if basis is None else (basis, common)
            out.append(search(rows, Index([i for i, _ in block], [t for _, t in block], basis, common)))
            block = []
    if block or not out:
        basis, common = latent_basis(rows) if basis is None and block else (basis, common)
        empty = np.zeros((DIM, RANK), np.float32)
        out.append(search(rows, Index([i for i, _ in block], [t for _, t in block], empty if basis is None else basis, common)))
    found = out[0]
    if len(out) > 1:  # every block has every row, by its number in the written table
        found = joined(out)
    return found.select("doc_id", "mark", (F.col("share") > 0).alias("contaminated"), "items", "share")
