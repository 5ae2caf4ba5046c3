from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import media as M
from lumenforge.functions import stats as S
from lumenforge.sources import media as SM
from lumenforge.sources import video as V


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("filters", [0, 1, 2])
def test_png_round_trip(channels, filters):
    x = M.synthetic(37, 53)
    x = np.concatenate([x, x[:, :, :1]], axis=2)[:, :, :channels] if channels != 1 else x[:, :, :1]
    data = M.encode_png(x, filters)
    assert M.probe(data)[:3] == ("png", 37, 53) and (M.decode_png(data) == x).all()


def slow_filters(x, kinds):
    """Rows filtered one byte at a time, by the definition."""
    h, w, c = x.shape
    rows = x.reshape(h, w * c).astype(int)
    out = bytearray()
    for y in range(h):
        out.append(kinds[y % len(kinds)])
        for i in range(w * c):
            a = rows[y, i - c] if i >= c else 0
            b = rows[y - 1, i] if y else 0
            d = rows[y - 1, i - c] if y and i >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out.append(int(rows[y, i] - [0, a, b, (a + b) // 2, paeth][kinds[y % len(kinds)]]) & 255)
    return bytes(out)


def test_all_filters():
    x = M.synthetic(9, 11, 3)
    data = M.encode_png(x)
    plain = [b for k, b in M.png_chunks(data) if k == b"IDAT"][0]
    body = zlib.compress(slow_filters(x, [0, 1, 2, 3, 4]))
    patched = data.replace(len(plain).to_bytes(4, "big") + b"IDAT" + plain + zlib.crc32(b"IDAT" + plain).to_bytes(4, "big"), len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big"))
    assert (M.decode_png(patched) == x).all()


def test_bad_headers():
    good = M.encode_png(M.synthetic(4, 4))
    assert M.probe(good[:-3])[4] == "media_decode"
    assert M.probe(good[:20] + b"\xff" + good[21:])[4] == "media_decode"
    assert M.probe(b"GIF89a")[4] == "unsupported_media" and M.probe(b"")[4] == "media_decode" and M.probe(None)[4] == "media_decode"
    assert M.probe(good, "jpeg")[4] == "media_decode"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01\xff\xd9"
    assert M.probe(jpeg) == ("jpeg", 16, 32, "RGB", None)
    webp = b"RIFF\x1a\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x10\x00\x00\x00\x1f\x00\x00\x0f\x00\x00" + b"\0" * 4
    assert M.probe(webp) == ("webp", 16, 32, "RGBA", None)


def test_colour():
    x = np.array([[[200, 100, 0, 0], [200, 100, 0, 255], [200, 100, 0, 128]]], dtype=np.uint8)
    assert M.to_rgb(x).tolist() == [[[255, 255, 255], [200, 100, 0], [227, 177, 127]]]


def test_resize():
    x = M.synthetic(64, 96)
    assert (M.resize_image(x, 64, 96) == x).all()
    assert (M.resize_image(np.full((40, 40, 3), 77, np.uint8), 64, 96) == 77).all()
    y = M.resize_image(x, 32, 48)
    assert S.ssim(M.resize_image(y, 64, 96)[:, :, 0], x[:, :, 0]) > 0.9
    assert np.abs(M.resize_frame(x, 32, 48).astype(int) - y).max() <= 1


def test_patches():
    x = M.synthetic(64, 96)
    rows = M.patchify(x[None])
    assert rows.shape == (24, 1536) and (M.unpatchify(rows, 1, 4, 6)[0] == M.normalise(x)).all()
    clip = np.stack([M.synthetic(32, 32, k) for k in range(3)])
    back = M.unpatchify(M.patchify(clip), 2, 2, 2)
    assert (back[:3] == M.normalise(clip)).all() and (back[3] == back[2]).all()
    assert rows[1, 0] == M.normalise(x[0:1, 16:17, 0:1])[0, 0, 0] and rows[2, 0] == M.normalise(x[16:17, 0:1, 0:1])[0, 0, 0]


def test_keys():
    a = M.image_key("f", b"t", "rgb8", M.synthetic(4, 4).tobytes(), None, 4, 4, 12, (None, 5, None, None))
    wide = np.zeros((4, 16), np.uint8)
    wide[:, :12] = M.synthetic(4, 4).reshape(4, 12)
    assert a == M.image_key("f", b"t", "rgb8", wide.tobytes(), None, 4, 4, 16, (None, 5, None, None))
    assert a != M.image_key("f", b"t", "rgb8", wide.tobytes(), None, 4, 4, 16, (5, None, None, None))
    frames = [M.synthetic(4, 4)]
    assert M.video_key("f", b"t", frames, True, False, (None,) * 5, (None,) * 4, None, [0]) != M.video_key("f", b"t", frames, True, False, (None,) * 5, (None,) * 4, [0.0], None)


def test_data_uris_and_files(spark, tmp_path):
    assert SM.data_uri("data:image/png;base64,aGk=\n", 10) == (b"hi", None)
    assert SM.data_uri("data:image/png,a%20+b", 10) == (b"a +b", None)
    assert SM.data_uri("data:text/plain,a", 10)[1] == "unsupported_media"
    assert SM.data_uri("data:image/png;base64,a*", 10)[1] == "media_decode"
    assert SM.data_uri("data:image/png,aaaaaaaaaaa", 10)[1] == "resource_limit"
    assert SM.url_path("file:///a%20b.png") == "/a b.png" and SM.url_path("FILE://host/x") == "//host/x"
    (tmp_path / "a.png").write_bytes(M.encode_png(M.synthetic(8, 8)))
    (tmp_path / "b.png").write_bytes(b"x" * 2000)
    rows = {r.path.rsplit("/", 1)[1]: r for r in SM.files(spark, str(tmp_path), {"encoded_bytes_per_item": 1000}).collect()}
    assert rows["b.png"].error == "resource_limit" and rows["b.png"].data is None
    size = spark.createDataFrame([(rows["a.png"].data,)], "d binary").select(M.png_size(F.col("d")).alias("s"), M.sniff(F.col("d")).alias("f")).first()
    assert (size.s.height, size.s.width, size.f) == (8, 8, "png")


def test_web(spark):
    urls = spark.createDataFrame([("u1",), ("u2",), ("u1",), (None,)], "url string")
    got = {r.url: (r.data, r.error) for r in SM.web(urls, get=lambda u, most: (u.encode(), None) if u == "u1" else (None, "unsupported_media")).collect()}
    assert got == {"u1": (b"u1", None), "u2": (None, "unsupported_media")}


def test_bounded():
    import io

    assert SM.bounded(io.BytesIO(b"x" * 11), None, 10)[1] == "resource_limit"
    assert SM.bounded(io.BytesIO(b"x" * 10), "10", 10) == (b"x" * 10, None)
    assert SM.bounded(io.BytesIO(b""), "11", 10)[1] == "resource_limit"


def test_frames(spark):
    x = np.arange(2 * 3 * 4 * 5).reshape(2, 3, 4, 5) % 256
    assert V.as_frames(x.astype(np.uint8)).shape == (2, 4, 5, 3)
    with pytest.raises(ValueError):
        V.as_frames(x.astype(float) + 0.5)
    rows = spark.createDataFrame([(1, b"", [0, 2])], "id long, data binary, indices array<long>")
    got = V.decode_frames(rows, lambda data, wanted: np.stack([np.full((2, 2, 3), k, np.uint8) for k in wanted])).collect()
    assert [(r.nth, bytes(r.data)) for r in got] == [(0, b"\0" * 12), (1, b"\2" * 12)]
