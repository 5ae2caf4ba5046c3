"""Pixels: headers, PNG, colour, resizing, patches and content keys, in numpy.

Kernels never raise on data: they return an error category. JPEG and WebP pixels need an optional codec (Pillow);
without it they are ``unsupported_media``. Headers of all three formats are read here.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.plans.profiles import MERGE, PATCH, TEMPORAL

# First bytes of file formats, and what PNG colour types hold: channels and legal depths.
MAGIC = {"jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n"}
OTHERS = {"gif": b"GIF8", "bmp": b"BM", "tiff": b"II*\x00", "tiff_be": b"MM\x00*"}
PNG_COLOR = {0: ("L", 1, (1, 2, 4, 8, 16)), 2: ("RGB", 3, (8, 16)), 3: ("P", 1, (1, 2, 4, 8)), 4: ("LA", 2, (8, 16)), 6: ("RGBA", 4, (8, 16))}
FORMATS = {"jpeg": 0, "png": 1, "webp": 2}


class BadMediaError(Exception):
    """Carries an error category."""


def sniff(content: Column) -> Column:
    """Format by first bytes: jpeg, png, webp, another name, or null."""

    def starts(x: bytes, at: int = 1) -> Column:
        return F.substring(content, at, len(x)) == F.lit(bytearray(x))

    out = F.when(starts(MAGIC["jpeg"]), "jpeg").when(starts(MAGIC["png"]), "png").when(starts(b"RIFF") & starts(b"WEBP", 9), "webp")
    for name, magic in OTHERS.items():
        out = out.when(starts(magic), name.removesuffix("_be"))
    return out.when(starts(b"ftypavif", 5), "avif")


def format_name(x: Column) -> Column:
    """jpeg, png or webp for a declared name in any case; null if unsupported."""
    x = F.lower(x)
    return F.when(x.isin("jpeg", "jpg"), "jpeg").when(x.isin("png", "webp"), x)


def png_size(content: Column) -> Column:
    """Height and width from a PNG header, without Python."""

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")

    return F.struct(number(21).alias("height"), number(17).alias("width"))


def sniffed(data: bytes) -> str | None:
    for name, magic in (MAGIC | OTHERS).items():
        if data.startswith(magic):
            return name
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise BadMediaError("media_decode")
        out.append((kind, body))
        if kind == b"IEND":
            return out
        at += 12 + n
    raise BadMediaError("media_decode")


def _probe_png(data: bytes) -> tuple[int, int, str]:
    chunks = png_chunks(data)
    if not chunks or chunks[0][0] != b"IHDR" or len(chunks[0][1]) != 13:
        raise BadMediaError("media_decode")
    w, h, depth, color, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    if color not in PNG_COLOR or depth not in PNG_COLOR[color][2] or rest[0] or rest[1] or rest[2] > 1 or not h or not w:
        raise BadMediaError("media_decode")
    mode = PNG_COLOR[color][0]
    if any(k == b"acTL" for k, _ in chunks):
        mode = "animated"
    return h, w, mode if depth <= 8 else f"{mode};16"


def _probe_jpeg(data: bytes) -> tuple[int, int, str]:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadMediaError("media_decode")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            body = data[at + 4 : at + 2 + n]
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise BadMediaError("media_decode")
            h, w = struct.unpack(">HH", body[1:5])
            mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(body[5])
            if not mode or not h or not w or any(not 1 <= x <= 4 for i in range(body[5]) for x in divmod(body[7 + 3 * i], 16)):
                raise BadMediaError("media_decode")
            return h, w, mode
        if kind in (0xD9, 0xDA) or n < 2:
            break
        at += 2 + n
    raise BadMediaError("media_decode")


def _probe_webp(data: bytes) -> tuple[int, int, str]:
    if len(data) < 30 or int.from_bytes(data[4:8], "little") + 8 > len(data):
        raise BadMediaError("media_decode")
    kind, body = data[12:16], data[20:]
    if kind == b"VP8X":
        w, h = (int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
        return h, w, "animated" if body[0] & 2 else "RGBA" if body[0] & 16 else "RGB"
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits >> 14 & 0x3FFF) + 1, (bits & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        w, h = (int.from_bytes(body[i : i + 2], "little") & 0x3FFF for i in (6, 8))
        return h, w, "RGB"
    raise BadMediaError("media_decode")


def probe(data: bytes | None, declared: str | None = None) -> tuple[str | None, int | None, int | None, str | None, str | None]:
    """format, height, width, mode, error, from the header alone."""
    kind = sniffed(data or b"")
    try:
        if kind not in FORMATS:
            raise BadMediaError("unsupported_media" if kind else "media_decode")
        if declared and declared != kind:
            raise BadMediaError("media_decode")
        return kind, *{"png": _probe_png, "jpeg": _probe_jpeg, "webp": _probe_webp}[kind](data), None
    except (BadMediaError, struct.error, IndexError) as e:
        return kind, None, None, None, str(e) if isinstance(e, BadMediaError) else "media_decode"


def mode_error(mode: str | None) -> str | None:
    """Modes that are refused, after the checks of sizes."""
    return "unsupported_media" if mode and (mode in ("LA", "P", "animated") or mode.endswith(";16")) else None


def _unfilter(raw: np.ndarray, height: int, row: int, step: int) -> np.ndarray:
    """Undo PNG row filters. Up and none are whole-row; the others run along the row, all channels at once."""
    lines = raw[: height * (row + 1)].reshape(height, row + 1)
    out = np.zeros((height + 1, row), np.uint8)
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            now, left, upper = out[y + 1], np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(0, row, step):
                b = above[x : x + step].astype(np.int32)
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - upper
                    pa, pb, pc = abs(p - left), abs(p - b), abs(p - upper)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, upper))
                now[x : x + step] = left = (line[x : x + step] + guess).astype(np.int32) & 255
                upper = b
        else:
            raise BadMediaError("media_decode")
    return out[1:]


def _png_samples(raw: np.ndarray, h: int, w: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples of one image in a stream of filtered rows, and how many bytes it took."""
    row = (w * channels * depth + 7) // 8
    if len(raw) < h * (row + 1):
        raise BadMediaError("media_decode")
    lines = _unfilter(raw, h, row, max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
        lines = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, : w * channels].astype(np.uint8)
    return lines.reshape(h, w, channels), h * (row + 1)


#: First column and row, and steps, of the seven passes of interlaced PNG.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a PNG of 8 bits or less."""
    chunks = png_chunks(data)
    w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", chunks[0][1])
    channels = PNG_COLOR[color][1]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), np.uint8)
    except zlib.error as e:
        raise BadMediaError("media_decode") from e
    if not laced:
        out, _ = _png_samples(raw, h, w, channels, depth)
    else:
        out = np.zeros((h, w, channels), np.uint8)
        for x, y, dx, dy in ADAM7:
            pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
            if pw > 0 and ph > 0:
                part, used = _png_samples(raw, ph, pw, channels, depth)
                out[y::dy, x::dx] = part
                raw = raw[used:]
    return out * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 and color == 0 else out


def to_rgb(x: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, alpha is laid over white, in whole numbers."""
    if x.shape[2] == 1:
        return np.repeat(x, 3, axis=2)
    if x.shape[2] == 4:
        a = x[:, :, 3:].astype(np.int32)
        return ((x[:, :, :3].astype(np.int32) * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)
    return x


def over_white(v: Column, a: Column) -> Column:
    """One channel over white, as a column."""
    return F.floor((v * a + 255 * (255 - a) + 127) / 255).cast("long")


def jpeg_ends(data: bytes) -> bool:
    """Whether a JPEG's scans end with an end marker, which entropy-coded data can't contain."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return False
        kind = data[at + 1]
        if kind == 0xD9:
            return True
        at += 2 if kind in (0x01, 0xFF, *range(0xD0, 0xD8)) else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA:
            while at + 1 < len(data) and (data[at] != 0xFF or data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
    return data[at : at + 2] == b"\xff\xd9"


def decode(data: bytes, kind: str, mode: str) -> np.ndarray:
    """RGB pixels of an encoded image. Orientation in EXIF is ignored."""
    if mode_error(mode):
        raise BadMediaError("unsupported_media")
    if kind == "png":
        return to_rgb(decode_png(data))
    if kind == "jpeg" and not jpeg_ends(data):
        raise BadMediaError("media_decode")
    try:
        from PIL import Image
    except ImportError as e:
        raise BadMediaError("unsupported_media") from e
    try:
        picture = Image.open(io.BytesIO(data))
        return to_rgb(np.asarray(picture.convert("RGBA" if mode == "RGBA" else "RGB")))
    except Exception as e:
        raise BadMediaError("media_decode") from e


def unpack_rgb(data: bytes, h: int, w: int, stride: int | None) -> np.ndarray:
    """A view of rows that may be padded."""
    stride = stride or 3 * w
    flat = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (h, 3 * w), (stride, 1)).reshape(h, w, 3)


def keys_cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=64)
def taps(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights of every output place: a cubic, widened when shrinking, cut at the edges and normalised."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    low = np.clip((centre - 2 * wide + 0.5).astype(np.int64), 0, None)
    high = np.minimum((centre + 2 * wide + 0.5).astype(np.int64), size)
    at = low[:, None] + np.arange(int((high - low).max()))
    w = np.where(at < high[:, None], keys_cubic((at - centre[:, None] + 0.5) / wide), 0.0)
    return np.minimum(at, size - 1), w / w.sum(axis=1, keepdims=True)


#: Rows that are resized at once: their sums stay in a core's cache.
_STRIP = 32


def _weighted(x: np.ndarray, at: np.ndarray, w: np.ndarray, start: np.generic) -> np.ndarray:
    """Weighted sums of rows of x (rows, values), on top of ``start``, in its type."""
    acc = np.full((len(at), x.shape[1]), start)
    for k in range(at.shape[1]):
        acc += x[at[:, k]] * w[:, k, None]
    return acc


def _fixed_rows(x: np.ndarray, to: int) -> np.ndarray:
    """Rows of bytes resized in 22-bit fixed point, rounded. Sums stay under 2**31: weights add up to 1, with small negative parts."""
    at, w = taps(len(x), to)
    w = np.trunc(w * (1 << 22) + np.where(w < 0, -0.5, 0.5)).astype(np.int32)
    half = np.int32(1 << 21)
    out = np.empty((to, x.shape[1]), np.uint8)
    for a in range(0, to, _STRIP):
        out[a : a + _STRIP] = np.clip(_weighted(x, at[a : a + _STRIP], w[a : a + _STRIP], half) >> 22, 0, 255)
    return out


def _float_rows(x: np.ndarray, to: int) -> np.ndarray:
    at, w = taps(len(x), to)
    w = w.astype(np.float32)
    out = np.empty((to, x.shape[1]), np.float32)
    for a in range(0, to, _STRIP):
        out[a : a + _STRIP] = _weighted(x, at[a : a + _STRIP], w[a : a + _STRIP], np.float32(0))
    return out


def _resized(x: np.ndarray, height: int, width: int, rows) -> np.ndarray:
    """Across, then down; columns are turned into rows for that."""
    if x.shape[1] != width:
        turned = np.ascontiguousarray(x.transpose(1, 0, 2))
        x = np.ascontiguousarray(rows(turned.reshape(len(turned), -1), width).reshape(width, x.shape[0], 3).transpose(1, 0, 2))
    if x.shape[0] != height:
        x = rows(np.ascontiguousarray(x).reshape(len(x), -1), height).reshape(height, width, 3)
    return x


def resize_image(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic in 22-bit fixed point: across, then down, rounded after each. The same size is a copy."""
    return _resized(x, height, width, _fixed_rows)


def resize_frame(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Single precision across, then down; then whole numbers of 0 to 255, half to even."""
    out = _resized(x.astype(np.float32), height, width, _float_rows)
    return np.round(np.clip(out, 0, 255)).astype(np.uint8)


def normalise(x: np.ndarray) -> np.ndarray:
    half = np.float32(127.5)
    return (x.astype(np.float32) - half) / half


_NORMAL = normalise(np.arange(256))


def patchify(frames: np.ndarray) -> np.ndarray:
    """Patches of frames of bytes (time, height, width, 3), normalised; an odd last frame counts twice.

    Rows go by time, outer row and column, then row and column in a merge group; values by channel, time, row and column.
    Bytes are moved before they become four times as large.
    """
    t, h, w, _ = frames.shape
    if t % TEMPORAL and t > 1:
        frames, t = np.concatenate([frames, frames[-1:]]), t + 1
    depth = 1 if t == 1 else TEMPORAL
    x = frames.reshape(t // depth, depth, h // PATCH // MERGE, MERGE, PATCH, w // PATCH // MERGE, MERGE, PATCH, 3)
    x = np.ascontiguousarray(x.transpose(0, 2, 5, 3, 6, 8, 1, 4, 7)).reshape(-1, 3, depth, PATCH * PATCH)
    out = np.take(_NORMAL, x)
    return (out if depth == TEMPORAL else np.repeat(out, TEMPORAL, axis=2)).reshape(-1, 3 * TEMPORAL * PATCH * PATCH)


def unpatchify(rows: np.ndarray, t: int, h: int, w: int) -> np.ndarray:
    """The normalised frames (2 * t, 16 * h, 16 * w, 3) again."""
    x = rows.reshape(t, h // MERGE, w // MERGE, MERGE, MERGE, 3, TEMPORAL, PATCH, PATCH)
    return x.transpose(0, 6, 1, 3, 7, 2, 4, 8, 5).reshape(t * TEMPORAL, h * PATCH, w * PATCH, 3)


def _some(kind: str, *values: float | None) -> bytes:
    """Each value as a flag and eight bytes, little end first."""
    return b"".join(b"\0" if v is None or v != v else b"\1" + struct.pack(kind, v) for v in values)


def _sized(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def image_key(fingerprint: str, tag: bytes, kind: str, data: bytes, fmt: str | None, h: int | None, w: int | None, stride: int | None, options: tuple) -> str:
    """SHA-256 of all that decides an image's patches. tag: tells versions of the contract apart."""
    parts = [tag, _sized(fingerprint.encode())]
    if kind == "encoded":
        parts += [b"encoded\0", bytes([FORMATS[fmt]]), _sized(data)]
    else:
        parts += [b"rgb8\0", struct.pack("<QQ", h, w), _sized(unpack_rgb(data, h, w, stride).tobytes())]
    return hashlib.sha256(b"".join(parts) + _some("<Q", *options)).hexdigest()


def video_key(fingerprint: str, tag: bytes, frames: list[np.ndarray], image_frames: bool, preprocessed: bool, sizes: tuple, rates: tuple, times: list[float] | None, indices: list[int] | None) -> str:
    """SHA-256 of all that decides a clip's patches."""
    parts = [tag, fingerprint.encode(), bytes([image_frames, preprocessed]), struct.pack("<Q", len(frames))]
    for f in frames:
        parts += [struct.pack("<QQ", *f.shape[:2]), f.tobytes()]
    parts += [_some("<Q", *sizes), _some("<d", *rates)]
    for kind, values in (("d", times), ("q", indices)):
        parts.append(b"\0" if values is None else b"\1" + struct.pack("<Q", len(values)) + struct.pack(f"<{len(values)}{kind}", *values))
    return hashlib.sha256(b"".join(parts)).hexdigest()


def synthetic(h: int, w: int, seed: int = 0) -> np.ndarray:
    """A gradient with texture, for tests and benchmarks."""
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * 255 // max(w - 1, 1)), (y * 255 // max(h - 1, 1)), (x * 7 + y * 13 + seed * 31) % 256], axis=2).astype(np.uint8)


def encode_png(x: np.ndarray, filters: int = 0) -> bytes:
    """An 8-bit PNG of grey, RGB or RGBA pixels; filters: row filter 0, 1 or 2. For tests and benchmarks."""
    h, w, c = x.shape
    flat = x.reshape(h, w * c)
    if filters == 1:
        flat = (x.astype(np.int16) - np.pad(x, ((0, 0), (1, 0), (0, 0)))[:, :-1]).astype(np.uint8).reshape(h, w * c)
    elif filters == 2:
        flat = flat - np.pad(flat, ((1, 0), (0, 0)))[:-1]
    raw = np.concatenate([np.full((h, 1), filters, np.uint8), flat], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    color = {1: 0, 3: 2, 4: 6}[c]
    return MAGIC["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
