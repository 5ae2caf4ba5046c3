from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import invariants as I
from lumenforge.operators import layout as L
from lumenforge.plans import errors, harness, observe, schema
from lumenforge.plans.engine import Engine
from lumenforge.queries.media import picture_requests
from lumenforge.sources import sinks


@pytest.fixture(scope="module")
def done(spark, sf):
    return Engine(spark).prepare_batch(picture_requests(spark, sf))


def test_order(spark, done):
    rows = done.sidecar.select("batch_id", "request_index", "modality", "occurrence_index", "grid_row", "pixel_start", "pixel_end", "patch_rows")
    assert I.order_errors(rows).count() == 0
    bad = rows.withColumn("pixel_end", F.col("pixel_end") + F.when(F.col("occurrence_index") == 1, 1).otherwise(0))
    assert {r.rule for r in I.order_errors(bad).collect()} == {"pixel start", "pixel range"}


def test_shapes(spark):
    text = spark.createDataFrame([(1, [1, 7], [1, 1], [0, 1]), (2, [1], [1], [0]), (2, [1, 2], [1, 1], [0, 0])], "batch_id long, input_ids array<long>, attention_mask array<long>, mm_token_type_ids array<long>")
    rows = spark.createDataFrame([(1, "image", 1, 2, 2, 4, 1), (3, "image", 1, 3, 2, 6, 1)], "batch_id long, modality string, grid_t long, grid_h long, grid_w long, patch_rows long, placeholder_count long")
    assert {(r.batch_id, r.rule) for r in I.shape_errors(text, rows).collect()} == {(2, "width"), (3, "grid")}


def test_prepared(spark):
    rows = [(1, "f", 1, 4, 4, b"\0" * 98304), (2, "g", 1, 4, 4, b""), (3, "f", 2, 4, 4, b""), (4, "f", 1, 3, 4, b""), (5, "f", 1, 2, 2, b""), (6, "f", 1, 4, 4, b"x")]
    df = spark.createDataFrame(rows, "id long, fingerprint string, grid_t long, grid_h long, grid_w long, patches binary")
    assert {(r.id, r.rule) for r in I.prepared_errors(df, "f").collect()} == {(2, "fingerprint"), (3, "frames"), (4, "merge"), (5, "size"), (6, "bytes")}


def test_sinks(spark, done, tmp_path):
    got = sinks.metadata_json(done.text, done.sidecar, done.layouts).orderBy("batch_id").first()
    found = json.loads(got.metadata)
    assert [r["request_index"] for r in found["requests"]] == sorted(r["request_index"] for r in found["requests"]) and found["media"][0]["pixel_start"] == 0
    for _ in range(2):
        sinks.append_log(done.errors.select("batch_id"), str(tmp_path / "log"))
        sinks.append_log(sinks.flat_fields(done.sidecar), str(tmp_path / "fields"))
    assert spark.read.json(str(tmp_path / "fields")).count() == 2 * done.sidecar.count()


def test_observation(done):
    report = json.loads(observe.observed(done).to_json())
    assert [s["outcome"] for s in report["spans"]] == ["ok"] * len(report["spans"]) and report["counters"]["patches"]["rows"] == report["counters"]["text"]["rows"]
    assert report["spans"][3]["parent"] == 2


def test_minimise():
    case = [{"messages": [{"role": "user", "content_items": [{"t": i} for i in range(6)]} for _ in range(4)]} for _ in range(5)]
    case[3]["messages"][2]["content_items"][4]["t"] = "bad"
    fails = lambda rs: any(i["t"] == "bad" for r in rs for m in r["messages"] for i in m.get("content_items") or [])
    assert harness.minimise(case, fails) == [{"messages": [{"role": "user", "content_items": [{"t": "bad"}]}]}]


def test_permutation(spark):
    """Requests in another order: outputs in that order."""
    texts = [f"text {i}" for i in range(6)]
    order = harness.permuted(6, 3, 1)
    assert sorted(order) == list(range(6))

    def prompts(which):
        rows = [{"batch_id": 1, "request_index": k, "profile": "vl", "messages": [{"role": "user", "content_text": texts[i]}], "options": {}} for k, i in enumerate(which)]
        return [r.expanded for r in Engine(spark).prepare_batch(spark.createDataFrame(rows, schema.REQUEST)).text.orderBy("request_index").collect()]

    straight = prompts(range(6))
    assert prompts(order) == [straight[i] for i in order]


def test_boundaries(spark):
    """One batch for each amount, all in one run."""
    rows, want = [], {}
    for b, (_, n, passes) in enumerate(harness.boundaries(("messages_per_request",))):
        messages = [{"role": "user" if k % 2 == 0 else "assistant", "content_text": "x"} for k in range(n)]
        rows.append({"batch_id": b, "request_index": 0, "profile": "vl", "messages": messages, "options": {}})
        want[b] = passes
    found = Engine(spark, {"messages_per_request": 3}).prepare_batch(spark.createDataFrame(rows, schema.REQUEST)).errors.collect()
    assert {r.batch_id: r.category for r in found} == {b: "resource_limit" for b, passes in want.items() if not passes}


def test_events_are_bounded(spark):
    rows = spark.createDataFrame([(1, k) for k in range(7)] + [(2, 0)], "g long, k long")
    kept, left = L.bounded_events(rows, "g", ["k"], 5)
    assert kept.count() == 6 and {r.g: r.dropped for r in left.collect()} == {1: 2, 2: 0}


def test_exceptions_by_category():
    assert set(errors.BY_CATEGORY) == set(errors.PRECEDENCE) and isinstance(errors.raised("media_decode", "x", at=1), errors.MediaDecodeError)


def test_tokens_leave_in_slices():
    """A worker holds the tokens of a few texts, not of a whole batch."""
    import os

    import pandas as pd
    import pytest

    from lumenforge.functions import tokens as T
    from lumenforge.queries.requests import TOKENIZER

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer")
    texts = [None if k % 7 == 3 else f"text {k} " * (k % 5) for k in range(700)]
    parts = list(T.tokenizer(TOKENIZER).func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= 256
    found = [(None, None, None) if x is None else (list(x), list(y), z) for part in parts for x, y, z in part.itertuples(index=False)]
    assert found == [(None, None, None) if x is None else T.encoded(TOKENIZER, x) for x in texts]
    decoded = [x for part in T.decoder(TOKENIZER).func(iter([pd.Series([x for x, _, _ in found])])) for x in part]
    assert decoded == texts
