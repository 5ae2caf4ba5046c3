from __future__ import annotations

import json

from lumenforge.plans.engine import Engine
from lumenforge.streaming import feed


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"batch_id": 1, "request_index": 0, "profile": "vl", "messages": [{"role": "user", "content_text": "hi"}], "options": {"add_generation_prompt": True}}
    bad = {"batch_id": 2, "request_index": 0, "profile": "vl", "messages": [{"role": "nobody", "content_text": "hi"}], "options": {}}
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, (good, bad))))
    q = feed.prepare_feed(Engine(spark), feed.read_feed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination()
    text = spark.read.parquet(str(tmp_path / "out" / "text")).collect()
    assert [(r.batch_id, r.expanded) for r in text] == [(1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n")]
    assert [(r.batch_id, r.category) for r in spark.read.parquet(str(tmp_path / "out" / "errors")).collect()] == [(2, "invalid_request")]
