"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

Every query is run whole: its result is written to Spark's no-op sink. Start-up and one warm-up query are left out.
Beside the seconds there are throughputs: rendered requests, planned pictures, prepared pictures and patch rows a second.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = (
    "chat_render_vl chat_render_thinking chat_validate request_counts placeholder_expand literal_placeholders nfc_texts json_texts smart_resize image_plan video_plan nframes clip_range sample_frames "
    "occurrence_offsets request_ranges batch_padding capacities first_error all_or_nothing unreferenced_inputs inline_inputs sample_summary nearest_rank pair_summary channel_metrics stage_ranking "
    "memory_highwater content_keys request_checks visual_prompts_vl tool_prompts image_headers prepare_text prepare_layout prepare_pixels"
).split()


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": "4m",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from lumenforge.queries import QUERIES
    from lumenforge.queries.media import pictured, picture_requests

    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run(names[0])
    took = {name: run(name) for name in names}
    more = {}
    if not sys.argv[1:]:
        from lumenforge.plans.engine import Engine

        requests = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
        done = Engine(spark).prepare_batch(picture_requests(spark, sf_dir))
        done.errors.count()
        began = time.perf_counter()
        sums = done.patches().agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("patches") / 6144).alias("rows")).first()
        spent = time.perf_counter() - began
        # The published workload's size: pictures of 1023 by 767, as many as keep all cores busy for a while.
        size = spark.range(24 * int(cpus)).select(F.col("id").alias("s_suppkey"), F.lit(767).alias("h"), F.lit(1023).alias("w"))
        large = Engine(spark).prepare_batch(pictured(size))  # making them is timed as well
        large.errors.count()
        began = time.perf_counter()
        whole = large.patches().agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("patches") / 6144).alias("rows")).first()
        spent_large = time.perf_counter() - began
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        more = {"requests_rendered_per_s": round(requests / took["chat_render_vl"], 1), "pictures_planned_per_s": round(lines / took["image_plan"], 1), "pictures_prepared_per_s": round(sums["n"] / spent, 1), "patch_rows_per_s": round(sums["rows"] / spent, 1),
                "pictures_1023x767_per_s": round(whole["n"] / spent_large, 1), "patch_rows_1023x767_per_s": round(whole["rows"] / spent_large, 1)}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "throughput": more, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
