"""Column helpers that several operators share. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.shipping import ship

SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs outside ``[\\x20\\x09-\\x0D]``; null counts as empty.

    Each word, with the space around it, becomes one letter: no array of words is built.
    """
    text = F.coalesce(text, F.lit(""))
    one = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(one).cast("long")).otherwise(F.lit(0).cast("long"))


def bare(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def unit(key: Column, salt: str) -> Column:
    """60 bits of MD5 of ``key`` and ``salt``; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt))), 1, 15), 16, 10).cast("long")


def mark() -> Column:
    """A hash of doc_id and text: tells rows that share a doc_id apart by their text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")
