"""Tables that cut lineage, kept in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset and the master is local (tests, a laptop) a
folder in the system's temporary directory is used; on a cluster that is an error, so nothing is ever
written to a machine's own disk. A lost executor loses none of these files.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_KEPT: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str, codec: str = "snappy", options: dict[str, str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again. keep: only ``clear()`` of all tables deletes it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lumenforge/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", codec).parquet(path)
    (_KEPT if keep else _MADE).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def made() -> int:
    """How many tables there are, for ``clear``."""
    return len(_MADE)


def clear(since: int | None = None) -> None:
    """Delete every table made, or those made since then. Call it once no lazy result still reads them."""
    old = _MADE[since or 0 :] + (_KEPT if since is None else [])
    del _MADE[since or 0 :]
    if since is None:
        _KEPT.clear()
    for spark, path in old:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        clear()
    except Exception:  # the session may be gone by now; its folder goes with it
        _MADE.clear()
