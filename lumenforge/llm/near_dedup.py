"""Near-dedup of documents by SuperMinHash.

1. Each text's set of word shingles gives a 128-bit key of the set, and band keys of its
   signature. Texts with equal sets are one class from here on, met by way of salts, so
   copies cost no links at all.
2. In each band bucket every class is a candidate of the least class there, the centre:
   at most ``bands`` candidates a class, whatever the size of the bucket.
3. The classes of a centre are tested on full sets, in tiles; see ``tiles``. Two classes that
   share a bucket share its centre, so no link between them is lost.
4. Components of the links are found by stars; see ``components``.

With 32 bands of 5 slots, two sets at a similarity of 0.8 share no bucket with odds of 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tiles
from .common import mark
from .components import components
from .minhash import band_keys, superminhash
from .textscan import chunks, mix64, shingles, words
from .tiles import Tester

SLOTS, BANDS, SALTS = 160, 32, 256


def _set_keys(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over each set; 0 for empty sets."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(elements ^ np.uint64(c)), dtype=np.uint64)]) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n_shingles, k1, k2 (set key), bands (empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                elements, first = shingles(*words(data, offsets), width)
                n = np.diff(first)
                k1, k2 = _set_keys(elements, first)
                keys = band_keys(superminhash(elements, first, SLOTS), BANDS).view(np.int64)[n > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("doc_id", "mark")), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), bands], ["doc_id", "mark", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), mark().alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its sorted distinct shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                elements, first = shingles(*words(data, offsets), width)
                raw = [elements[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(raw, pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles binary")


def set_tester(similar: int) -> Tester:
    """Links sets with a Jaccard similarity of ``similar`` percent or more."""

    def tester(raw: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([len(x) // 8 for x in raw])
        values, codes = np.unique(np.frombuffer(b"".join(raw), dtype=np.uint64), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flag = np.zeros(len(values) + 1, dtype=np.int64)

        def near(p: int, apart: np.ndarray) -> np.ndarray:
            mine = codes[begin[p] : begin[p + 1]]
            flag[mine] = 1
            counts = np.concatenate([[0], np.cumsum(flag[codes])])
            both = counts[begin[1:]] - counts[begin[:-1]]
            flag[mine] = 0
            return np.flatnonzero((100 * both >= similar * (sizes + sizes[p] - both)) & (sizes > 0) & apart)

        return near

    return tester


def links(docs: DataFrame, classes: DataFrame, width: int, similar: int) -> DataFrame:
    """Links a, b between classes, enough to join all that are linked."""
    bands = classes.where("n_shingles > 0").select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "key"))
    centres = bands.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = bands.join(scratch.table(centres.drop("n"), "centres"), ["band", "key"]).where("id <> centre").select("centre", "id").distinct()

    def payloads(ids: DataFrame) -> DataFrame:
        return sets_of(docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), width).toDF("id", "payload")

    return tiles.links(scratch.table(near, "candidates"), payloads, set_tester(similar))


def near_dedup(docs: DataFrame, width: int = 5, similar: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``similar`` percent or more.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id,
    n_shingles, component_id (least doc_id that can be reached), kept (doc_id = component_id), mark.
    Texts without words (null, empty, white space) are linked with nothing. Rows that repeat a
    doc_id are one document where they are linked, and each stays a row. A null doc_id has no
    place in the order of identifiers: such a row is linked with nothing and kept. An empty table gives
    an empty result.
    """
    prints = scratch.table(fingerprints(docs, width), "fingerprints")
    named = prints.where("doc_id is not null")
    key = ["k1", "k2", "n_shingles"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    spread = named.where("n_shingles > 0").groupBy(*key, salt).agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = spread.groupBy(*key).agg(F.min("least").alias("least")).select(*key, F.col("least.doc_id").alias("rep"), F.col("least.bands").alias("bands"))
    classes = scratch.table(classes, "classes")
    grouped = scratch.table(components(links(docs, classes, width, similar)), "components")
    classes = classes.drop("bands").join(grouped, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    classes = scratch.table(classes, "class_components")
    by_salt = spread.select(*key, "salt").join(classes, key)
    out = prints.withColumn("salt", F.coalesce(salt, F.lit(0).cast("long"))).join(by_salt, [*key, "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "mark")


#: For two-word shingles, on tables that DuckDB can join with themselves.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS shingles FROM d),
s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (doc_id)
"""
