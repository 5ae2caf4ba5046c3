"""Exact dedup by a tree merge of digest runs. DataFrame functions only.

Rows are numbered once, in a written table, and dealt to ``2 ** depth`` runs by a hash of their number. A run holds one entry
per digest: how many rows it stands for and its smallest identifier. Runs are merged in
binomial rounds: in each, the runs whose numbers agree after dropping ``log2(fan_in)`` bits
become one. A round sorts its runs by digest and merges them entry by entry (Spark's sort-based aggregate, which a
least struct asks for); each run is merged with itself before it is sent, so a digest
that holds a third of all rows reaches a reducer as at most ``fan_in`` entries. Entries
merge only where SHA-256, length and a second, independent hash all agree, so the smallest identifier of every level is verified.

The way back is the same tree: the root's answer meets the entries of level 0, of which a
digest has one per run, and rows then join on (digest, run). No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .common import bare

KEY = ["digest", "check", "n_bare"]


def digests(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, digest columns, original length, number and run of every row."""
    text = bare(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.length(text).alias("n_bare"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int"))


def merge_runs(level: DataFrame, bits: int) -> DataFrame:
    """One round: runs that agree after dropping ``bits`` bits become one."""
    return level.groupBy(*KEY, F.shiftright("run", bits).alias("run")).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, depth: int = 8, fan_bits: int = 4) -> DataFrame:
    """Which row stays of those equal after deleting white space.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id,
    keep_id, group_size, kept, text_sha256. The row with the longest original text stays,
    then the smallest doc_id (null last). Null text is empty text; empty texts are equal. Of rows that
    repeat a doc_id and tie, one is kept. An empty table gives an empty result.
    """
    rows = scratch.table(digests(docs, 2**depth), "digests")
    best = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    level = leaves = rows.groupBy(*KEY, "run").agg(F.min(best).alias("first"), F.count(F.lit(1)).alias("n"))
    for down in range(0, depth, fan_bits):
        level = merge_runs(level, min(fan_bits, depth - down))
    root = scratch.table(level.where("n > 1").drop("run"), "groups")
    spread = leaves.select(*KEY, "run").join(root, KEY)
    shared = rows.join(spread, [*KEY, "run"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.col("n").isNull() | (F.col("row") == F.col("first.row"))
    return shared.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents),
g AS (SELECT b, arg_min(doc_id, (-length(t), doc_id)) AS keep_id, count(*) AS n FROM d GROUP BY b)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(d.b) AS text_sha256
FROM d JOIN g ON d.b = g.b
"""
