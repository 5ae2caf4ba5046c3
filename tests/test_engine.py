from __future__ import annotations

import os

import numpy as np
import pytest

from lumenforge.functions import media as M
from lumenforge.functions import tokens as K
from lumenforge.plans import errors, schema
from lumenforge.plans.engine import Engine
from lumenforge.plans.limits import LIMITS, lowered

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def rgb(h, w, seed=0):
    return {"kind": "rgb8", "data": M.synthetic(h, w, seed).tobytes(), "format": None, "height": h, "width": w, "row_stride": None}


def png(h, w, seed=0):
    return {"kind": "encoded", "data": M.encode_png(M.synthetic(h, w, seed)), "format": "PNG", "height": None, "width": None, "row_stride": None}


def clip(n, h, w, **more):
    frames = [{"data": M.synthetic(h, w, k).tobytes(), "height": h, "width": w, "row_stride": None} for k in range(n)]
    return {"frames": frames, **more}


def ask(*items, role="user"):
    return {"role": role, "content_items": [{"type": k, **({"text": v} if k == "text" else {"input_index": v})} for k, v in items]}


def request(b, r, messages, images=None, videos=None, profile="vl", **options):
    return {"batch_id": b, "request_index": r, "profile": profile, "messages": messages, "images": images, "videos": videos, "options": options}


@pytest.fixture(scope="module")
def prepared(spark):
    hello = {"role": "user", "content_text": "hello"}
    rows = [
        request(1, 0, [ask(("image", 0), ("text", "what?"), ("image", 1))], [rgb(70, 100), png(64, 64, 5)], add_generation_prompt=True),
        request(1, 1, [ask(("video", 0))], None, [clip(3, 64, 64, fps=10.0)]),
        request(2, 0, [hello], [rgb(64, 64)]),
        request(2, 1, [hello]),
        request(3, 0, [ask(("image", 0))], [png(64, 64) | {"data": b"\x89PNG\r\n\x1a\nbroken"}]),
        request(4, 0, [hello], profile="vl", enable_thinking=True),
        request(5, 0, [hello], profile="thinking", add_generation_prompt=True),
        request(6, 0, [{"role": "user", "content_text": "see <|image_pad|>"}]),
        request(7, 0, [ask(("image", 0), ("image", 1))], [png(64, 64) | {"data": b"junk"}, rgb(64, 64) | {"height": 1, "width": 40000, "data": b"\0" * 120000}]),
    ]
    return Engine(spark).prepare_batch(spark.createDataFrame(rows, schema.REQUEST))


def test_errors(prepared):
    got = {r.batch_id: r.category for r in prepared.errors.collect()}
    assert got == {2: "invalid_request", 3: "media_decode", 4: "unsupported_option", 6: "invalid_request", 7: "resource_limit"}


def test_text(prepared):
    text = {(r.batch_id, r.request_index): r.expanded for r in prepared.text.collect()}
    assert set(text) == {(1, 0), (1, 1), (5, 0)}
    assert text[1, 0].count("<|image_pad|>") == 2 * 3 + 4
    assert text[1, 1].count("<|video_pad|>") == 2 * text[1, 1].count("<|video_pad|>") // 2 and "<0.1 seconds>" in text[1, 1] and "<0.2 seconds>" in text[1, 1]
    assert text[5, 0].endswith("<think>\n")


def test_sidecar_and_layouts(prepared):
    rows = sorted(prepared.sidecar.collect(), key=lambda r: r.occurrence_index)
    assert [(r.modality, r.grid_row, r.pixel_start, r.pixel_end) for r in rows[:2]] == [("image", 0, 0, 24), ("image", 1, 24, 40)]
    ranges = {(r.request_index, r.modality): (r.grid_start, r.grid_end, r.pixel_start, r.pixel_end) for r in prepared.layouts.where("batch_id = 1").collect()}
    assert ranges[0, "image"] == (0, 2, 0, 40) and ranges[1, "image"] == (2, 2, 40, 40) and ranges[0, "video"] == (0, 0, 0, 0)


def test_pixels(prepared):
    got = {(r.request_index, r.content_item_index): r for r in prepared.patches().where("batch_id = 1").collect()}
    first = np.frombuffer(bytes(got[0, 0].patches), np.float32).reshape(-1, 1536)
    assert (first == M.patchify(M.resize_image(M.synthetic(70, 100), 64, 96)[None])).all()
    assert len(got) == 3 and all(r.error is None and len(r.cache_key) == 64 for r in got.values())


def test_limits():
    assert lowered({"media_per_batch": 3})["media_per_batch"] == 3
    with pytest.raises(errors.UnsupportedOptionError):
        lowered({"media_per_batch": LIMITS["media_per_batch"] + 1})
    with pytest.raises(errors.InvalidRequestError):
        lowered({"media_per_batch": True})


def test_raise_first(spark):
    with pytest.raises(errors.InvalidRequestError):
        Engine(spark).prepare([{"role": "narrator", "content_text": "x"}])
    done = Engine(spark, {"messages_per_request": 1})
    with pytest.raises(errors.ResourceLimitError):
        done.prepare([{"role": "user", "content_text": "x"}, {"role": "assistant", "content_text": "y"}])


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_tokens(spark):
    e = Engine(spark, tokenizer_path=TOKENIZER, tokenizer_sha256=K.file_hash(TOKENIZER))
    rows = [request(1, 0, [{"role": "user", "content_text": "hello there, é"}]), request(1, 1, [ask(("image", 0))], [rgb(64, 64)])]
    done = e.prepare_batch(spark.createDataFrame(rows, schema.REQUEST), "left")
    assert done.errors.count() == 0 or {r.category for r in done.errors.collect()} == {"internal_invariant"}
    out = done.tokens.orderBy("request_index").collect()
    assert all(len(r.token_ids) == len(r.token_starts) for r in out)
    with pytest.raises(errors.ProfileMismatchError):
        Engine(spark, tokenizer_path=TOKENIZER, tokenizer_sha256="0")
    arrays = done.collect_batch(1)
    if arrays["input_ids"].size:
        assert arrays["input_ids"].shape == arrays["attention_mask"].shape and arrays["pixel_values"].shape == (16, 1536) and arrays["image_grid_thw"].tolist() == [[1, 4, 4]]


def test_token_spans():
    assert K.token_span([0, 3, 5], 9, 3, 9) == (1, 3) and K.token_span([0, 3, 5], 9, 4, 9) is None


def test_profiles(spark):
    assert spark.createDataFrame(Engine(spark).profiles().collect()).count() == 2
