"""A continuous feed of requests. Each micro-batch is prepared like any other input; failed batches go to a table of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenforge.plans import schema
from lumenforge.plans.engine import Engine


def read_feed(spark: SparkSession, path: str, kind: str = "json", files_per_trigger: int = 64) -> DataFrame:
    """Requests that arrive as files."""
    return spark.readStream.schema(schema.REQUEST).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def prepare_feed(engine: Engine, feed: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write text and errors of every micro-batch under ``out``, by the micro-batch's number: a retried one overwrites itself."""

    def each(rows: DataFrame, number: int) -> None:
        done = engine.prepare_batch(rows)
        done.text.write.mode("overwrite").parquet(f"{out}/text/micro={number}")
        done.errors.write.mode("overwrite").parquet(f"{out}/errors/micro={number}")

    writer = feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reuse(feed: DataFrame, key: str = "cache_key", late: str = "1 hour", at: str = "seen_at") -> DataFrame:
    """The first row of each content key within a watermark."""
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(feed: DataFrame, at: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests and text bytes by time window, late rows within the watermark included."""
    return feed.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("requests"), F.sum("text_bytes").alias("text_bytes"))
