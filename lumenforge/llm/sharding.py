"""Sharding by vector bin packing.

Equal texts form a group, which stays together unless it has more than half of a shard's bytes; only then is it cut,
into pieces by a hash of doc_id. Groups over ``1 / 800`` of all bytes, at most 800 whatever the data, are placed one by one.
The other groups are gathered into a fixed number of bundles by a hash of the text. So the packing places a bounded number of units
(bundles, large groups and pieces), each with its demand of bytes, tokens and rows, on the driver: largest
first, each where the dot product of its demand with the shards' residual capacity is highest.
Bytes weigh most, as the law is ``bytes``.

A unit lies in one shard, so the slot of a document is its unit's offset in its shard plus
its rank in its unit. Units are cut by a further hash into parts of about ``PART`` rows; only rows of one part are ever ordered together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .common import word_count

BUNDLES, HOT_PARTS, PIECES_PER_SHARD, PART = 8192, 20, 100, 4096
WEIGHT = np.array([16.0, 1.0, 1.0])


def measured(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, size, CRC-32, group and a further hash of every document, and the columns ``more``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
        F.xxhash64("doc_id", text, F.lit("piece")).alias("apart"),
        *more,
    )


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit. demand: units by (bytes, tokens, rows)."""
    total = demand.sum(axis=0).astype(float)
    share = demand / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, 3))
    out = np.zeros(len(demand), dtype=np.int64)
    order = np.lexsort((np.arange(len(demand)), -(share @ WEIGHT)))
    for i in order:
        out[i] = best = int(np.argmax(left @ (share[i] * WEIGHT)))
        left[best] -= share[i]
    return out


def placed(rows: DataFrame, shards: int, bundles: int) -> tuple[DataFrame, DataFrame, int]:
    """What places documents, all of bounded size: large groups (same, first unit, pieces); parts of units (unit, part, shard, slot of its first row); parts a unit.

    rows: size, tokens, same, apart, a written table.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("same").agg(F.sum("size").alias("size"))
    large = groups.where(F.col("size") * (shards * HOT_PARTS) > F.lit(total)).collect()  # at most shards * HOT_PARTS rows
    piece = max(1, total // (shards * PIECES_PER_SHARD))
    cut = sorted((r["same"], -(-int(r["size"]) // piece) if 2 * shards * r["size"] > total else 1) for r in large)
    first = np.concatenate([[0], np.cumsum([c for _, c in cut])]).astype(int)
    large = spark.createDataFrame([(k, bundles + int(first[i]), c) for i, (k, c) in enumerate(cut)], "hot long, first long, pieces long")
    # At most bundles + shards * (PIECES_PER_SHARD + HOT_PARTS) rows.
    rows = scratch.table(unit_of(rows, large, bundles).select("unit", "size", "tokens", "apart"), "units")
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()
    where = pack(np.array([[u["size"], u["tokens"], u["n"]] for u in units], dtype=float).reshape(-1, 3), shards)
    offset, filled = [], [0] * shards
    for u, s in zip(units, where, strict=True):
        offset.append(filled[s])
        filled[s] += u["n"]
    at = [(u["unit"], int(s), int(o)) for u, s, o in zip(units, where, offset, strict=True)]
    at = spark.createDataFrame(at, "unit long, shard int, offset long")
    parts = max(1, -(-max((u["n"] for u in units), default=1) // PART))
    sized = rows.groupBy("unit", part_of(parts).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.select("unit", "part", before.alias("before")).join(F.broadcast(at), "unit")
    return large, scratch.table(sized.select("unit", "part", "shard", (F.col("offset") + F.col("before")).alias("start")), "parts"), parts


def unit_of(rows: DataFrame, large: DataFrame, bundles: int) -> DataFrame:
    """rows with their unit."""
    rows = rows.join(F.broadcast(large), F.col("same") == F.col("hot"), "left")
    piece = F.col("first") + F.pmod("apart", F.col("pieces"))
    return rows.withColumn("unit", F.coalesce(piece, F.pmod(F.xxhash64("same", F.lit("bundle")), F.lit(bundles)).cast("long"))).drop("hot", "first", "pieces")


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("apart", F.lit("part")), F.lit(parts)).cast("int")


def shard(docs: DataFrame, shards: int = 40, bundles: int = BUNDLES, row: str | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards whose bytes, tokens and rows are balanced.

    docs: doc_id, text. Returns one row per input row:
    doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``). ``row`` names a struct of
    all columns of docs to carry; then whole rows are shuffled once, to their part of a shard.
    Null text is empty text and has no bytes beyond the 16 of a record. Rows that repeat a
    doc_id each get a slot of their own. An empty table gives an empty result.
    """
    rows = scratch.table(measured(docs, word_count(F.col("text")).alias("tokens")), "measured")
    large, at, parts = placed(rows, shards, bundles)
    if row:
        rows = measured(docs, F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias(row))
    rows = unit_of(rows, large, bundles).withColumn("part", part_of(parts))
    inside = Window.partitionBy("unit", "part").orderBy(F.col("doc_id").isNull(), "doc_id", "apart")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(at, ["unit", "part"])
    more = [row] if row else []
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more
    )
