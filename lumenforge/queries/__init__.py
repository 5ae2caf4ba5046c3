"""Driver queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that go to one partition where its rows are dealt by a key: a task's sorts stay as large however long the table is.
PART = 1 << 22


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """The rows by hash of ``keys``, in as many partitions as ``source``'s files ask for; what groups by these and more keys needs no further shuffle."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART)), *keys)


#: Bytes of pictures that are made in one partition.
PICTURES = 1 << 24


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows h, w, dealt by ``key`` to all cores, and to so many partitions that the RGB pictures of one are about ``PICTURES`` bytes: workers get no larger batches."""
    size = rows.agg(F.sum(F.col("h").cast("long") * F.col("w") * 3)).first()[0] or 0
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // PICTURES)), key)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import chat, geometry, layout, media, requests, stats  # noqa: E402, F401
