"""Bytes of images: files through Spark's own reader, data URIs, and the web through a partitioned reader.

Sizes are checked before contents are read. Every function gives an error category instead of raising.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lumenforge.plans.limits import LIMITS

_FOUND = StructType([StructField("data", BinaryType()), StructField("error", StringType())])
AGENT = {"User-Agent": "Mozilla/5.0 (compatible; lumenforge)"}


def files(spark: SparkSession, path: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """path, length, data, error. Files over the limit are told by their length; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    most = limits["encoded_bytes_per_item"]
    small = rows.where(F.col("length") <= most).select("path", "length", F.col("content").alias("data"), F.lit(None).cast("string").alias("error"))
    large = rows.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("data"), F.lit("resource_limit").alias("error"))
    return small.unionByName(large)


def url_path(url: str | None) -> str | None:
    """Path of a file URL, percent signs decoded; a host is a network share."""
    if url is None or not url.lower().startswith("file:"):
        return None
    parts = urllib.parse.urlsplit(url)
    path = urllib.parse.unquote(parts.path)
    return path if parts.netloc in ("", "localhost") else f"//{parts.netloc}{path}"


@F.pandas_udf(StringType())
def file_url_path(x: pd.Series) -> pd.Series:
    return x.map(url_path)


def data_uri(uri: str | None, most: int) -> tuple[bytes | None, str | None]:
    """Bytes and error of ``data:image/…[;base64],…``."""
    if uri is None:
        return None, None
    head, comma, body = uri.partition(",")
    kind, *flags = head[5:].split(";")
    if not comma or not uri[:5].lower() == "data:" or not kind.lower().startswith("image/"):
        return None, "unsupported_media"
    if "base64" not in [f.lower() for f in flags]:
        raw = urllib.parse.unquote_to_bytes(body)
        return (raw, None) if len(raw) <= most else (None, "resource_limit")
    if len(body) // 4 * 3 - 3 > most and len(re.sub(r"\s", "", body)) // 4 * 3 - 3 > most:
        return None, "resource_limit"
    try:
        raw = base64.b64decode(re.sub(rb"\s", b"", urllib.parse.unquote_to_bytes(body)), validate=True)
    except (binascii.Error, ValueError):
        return None, "media_decode"
    return (raw, None) if len(raw) <= most else (None, "resource_limit")


@F.pandas_udf(_FOUND)
def from_data_uri(x: pd.Series) -> pd.DataFrame:
    """data and error of each data URI."""
    return pd.DataFrame([data_uri(v, LIMITS["encoded_bytes_per_item"]) for v in x], columns=["data", "error"])


def bounded(stream, declared: str | None, most: int) -> tuple[bytes | None, str | None]:
    """All of a stream, unless it states or has more bytes than allowed."""
    if declared and declared.isdigit() and int(declared) > most:
        return None, "resource_limit"
    parts, n = [], 0
    while block := stream.read(min(65536, most + 1 - n)):
        parts.append(block)
        n += len(block)
        if n > most:
            return None, "resource_limit"
    return b"".join(parts), None


def fetch(url: str, most: int) -> tuple[bytes | None, str | None]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT), timeout=30) as r:  # noqa: S310
            return bounded(r, r.headers.get("Content-Length"), most)
    except (urllib.error.URLError, OSError, ValueError):
        return None, "unsupported_media"


def web(urls: DataFrame, column: str = "url", limits: dict[str, int] = LIMITS, get: Callable[[str, int], tuple] = fetch) -> DataFrame:
    """url, data, error of web addresses; each address once, spread over tasks. get: what reads one."""
    most = limits["encoded_bytes_per_item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                data, error = get(url, most)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["url", "data", "error"])

    rows = urls.select(F.col(column).alias("url")).where("url is not null").distinct()
    return rows.mapInArrow(run, "url string, data binary, error string")
