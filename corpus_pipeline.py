"""From raw documents to balanced shards of a mixed, clean corpus.

Each stage takes documents with any further columns, and all but the last return just those columns.
Repeated rows and null doc_ids are kept or dropped as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import decontaminate, mixing, near_dedup, scratch, sharding, toxicity
from lumenforge.llm.common import mark, read
from lumenforge.shipping import ship

ORACLE_SQL = None
#: Names of columns that stages add and take away again; they clash with none of the documents'.
ROW, SCORE, COPIES, DOC, MARK, N = (f"_lumenforge_{x}" for x in ("row", "score", "copies", "doc", "mark", "n"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7 stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, tuple(x for x in docs.columns if x != "doc_id"), SCORE)
    return scored.where(F.col(SCORE) < toxicity.CUT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, the one of least doc_id stays; of rows equal in doc_id and text, one."""
    ship(spark)
    found = near_dedup.near_dedup(docs).where("not kept").select(F.col("doc_id").alias(DOC), F.col("mark").alias(MARK)).distinct()
    kept = docs.join(found, (F.col("doc_id") == F.col(DOC)) & (mark() == F.col(MARK)), "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(N)).where(F.col(N) > 1).select("doc_id")
    twice = scratch.table(twice, "repeated")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark stay."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    found = scratch.table(found.select(F.col("doc_id").alias(DOC), F.col("mark").alias(MARK)).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(DOC)) & (mark() == F.col(MARK)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.copies(docs, COPIES).where(F.col(COPIES) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES))).alias(N)).drop(N)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with law, shard and slot, and their size and CRC-32; columns of docs with these names come last, with ``_before`` added."""
    new = ["law", "shard", "slot", "size", "text_crc32"]
    old = [F.col(f"{ROW}.{x}") for x in docs.columns if x not in new]
    return sharding.shard(docs, row=ROW).select(*old, *new, *(F.col(f"{ROW}.{x}").alias(f"{x}_before") for x in docs.columns if x in new))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = scratch.made()
        kept = scratch.table(stage(spark, docs, sf_dir), name, "zstd", keep=True)
        scratch.clear(before)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
