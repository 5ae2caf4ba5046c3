"""Words of many texts at once, in numpy.

Texts stay in Arrow's byte buffer; no Python string is made for a word. A word's hash is a
polynomial over a random table of byte values, modulo 2**64 by a base that is odd and so
has an inverse; prefix sums give every word's hash in a few passes. Hashes stand for words:
two different words get one hash with odds of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together. Temporary arrays take about 50 times that.
CHUNK = 1 << 18
_BASE, _U = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer; wraps modulo 2**64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers, and those of its inverse. Only the first CHUNK are kept."""

    def powers(base: np.uint64) -> np.ndarray:
        x = np.full(max(n, CHUNK), base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    if _POWERS and n <= CHUNK:
        return _POWERS[0][:n], _POWERS[1][:n]
    up, down = powers(_BASE), powers(_U(pow(int(_BASE), -1, 2**64)))
    if n <= CHUNK:
        _POWERS[:] = up, down
    return up[:n], down[:n]


def _word_edges(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = table[data]
    before = np.empty_like(word)
    before[1:], before[:1] = word[:-1], False
    some = offsets[:-1] < offsets[1:]
    before[offsets[:-1][some]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1], after[-1:] = word[1:], False
    after[offsets[1:][some] - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of pieces of what ``chunks`` gives: texts of CHUNK bytes stay whole, a longer one is cut where ``table`` marks no byte.

    A run of marked bytes is never cut, so one that is longer than CHUNK is a piece by itself.
    """
    if len(offsets) > 2 or len(data) <= CHUNK:
        yield data, offsets
        return
    a = 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        if b < len(data):
            gaps = np.flatnonzero(~table[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < len(data) and table[data[b]]:
                    b += 1
        yield data[a:b], np.array([0, b - a])
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes in ``table``), and the place in them where each text's words begin (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    out = []
    for part, cut in pieces(data, offsets, table):
        starts, ends = _word_edges(part, cut, table)
        hashed = hasher(_LOWER[part] if lower else part)(starts, ends)
        if cut is offsets:
            return hashed, np.searchsorted(starts, offsets)
        out.append(hashed)
    hashed = np.concatenate(out)
    return hashed, np.array([0, len(hashed)])


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A hash of byte ranges, given by their starts and ends."""
    if not len(data):
        return lambda a, b: np.zeros(len(a), np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return lambda a, b: mix64(((sums[b] - sums[a]) * down[np.minimum(a, len(data) - 1)]) ^ ((b - a).astype(np.uint64) << _U(52)))


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A hash of byte ranges; starts, ends and text of each run of bytes that ``table`` marks."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return hasher(data), none, none, none
    starts, ends = _word_edges(data, offsets, table)
    return hasher(data), starts, ends, np.searchsorted(offsets, starts, "right") - 1


def common_length(x: np.ndarray, y: np.ndarray, least: int = 0) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004).

    With ``least`` it stops where the length can't be as much any more, and gives a bound under ``least``: what the beginnings
    have in common, if the rests of both texts were of one length and equal.
    """
    at: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    mask = (1 << len(x)) - 1
    v = mask
    step = 32 if least else max(1, len(y))
    for a in range(0, len(y), step):
        for w in y[a : a + step].tolist():
            if m := at.get(w):
                u = v & m
                v = (v + u) | (v - u)
        rest = len(y) - a - step
        if least and rest > 0:
            cut = max(0, len(x) - rest)
            most = cut - (v & ((1 << cut) - 1)).bit_count() + min(rest, len(x))
            if most < least:
                return most
    return len(x) - (v & mask).bit_count()


def _low_bits(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, n from 0 to 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ~_U(0), (_U(1) << np.minimum(n, _U(63))) - _U(1))


def common_lengths(xs: list[np.ndarray], ys: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """``common_length`` of each of many pairs, of letters 0 to 63. Where it can't be ``least`` any more, a bound under that.

    All pairs take a step at a time. Word w of the bits of an x is w letters of y behind word 0, so its carry is there when it is needed.
    """
    m, n = (np.array([len(t) for t in z]) for z in (xs, ys))
    words, long, all_x, all_y = -(-int(m.max()) // 64), int(n.max()), np.concatenate(xs), np.concatenate(ys)
    end = 1 + int(max(all_x.max(), all_y.max()))  # a letter that no x has
    x = np.full((len(xs), words * 64), end)
    x[np.arange(words * 64) < m[:, None]] = all_x
    y = np.full((len(ys), long + words), end)
    y[np.arange(long + words) < n[:, None]] = all_y
    y = np.ascontiguousarray(y.T) * words
    place = np.arange(len(xs)) * (end + 1) * words + np.arange(words)[:, None]
    at = np.zeros(len(xs) * (end + 1) * words, dtype=np.uint64)
    x = x.reshape(-1, words, 64) * words
    for bit in range(64):  # no two positions of this bit share a word of ``at``
        at[place.T + x[:, :, bit]] |= _U(1) << _U(bit)
    at.reshape(-1, end + 1, words)[:, end] = 0
    out, who = np.zeros(len(xs), dtype=np.int64), np.arange(len(xs))
    v, carry, letter = np.full(place.shape, ~_U(0)), np.zeros(place.shape, np.uint64), np.full(place.shape, end * words)
    for t in range(long + words - 1):
        letter[1:] = letter[:-1].copy()
        letter[0] = y[t]
        u = v & at[place + letter]
        total = v + u
        over = total < u
        total += carry
        over |= total < carry
        carry[1:] = over[:-1]
        v ^= u
        v |= total
        if t % 32 == 31 and t >= words:
            rest = np.maximum(n - (t - words + 2), 0)  # letters of y that not all words have seen
            low = _low_bits(np.maximum(m - rest, 0) - 64 * np.arange(words)[:, None])
            most = np.bitwise_count(~v & low).sum(axis=0, dtype=np.int64) + np.minimum(rest, m)
            done = most < least
            if 8 * int(done.sum()) > len(who):
                out[who[done]] = most[done]
                who, m, n, least = (z[~done] for z in (who, m, n, least))
                if not len(who):
                    return out
                v, carry, letter, place, y = (np.ascontiguousarray(z[:, ~done]) for z in (v, carry, letter, place, y))
    out[who] = np.bitwise_count(~v & _low_bits(m - 64 * np.arange(words)[:, None])).sum(axis=0, dtype=np.int64)
    return out


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end, bytes, offsets) of whole texts, of about CHUNK bytes unless one text is longer. Null is empty.

    Only the piece at hand is copied, and brought to lower case where asked for.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        part = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
        part = pc.utf8_lower(part) if lower else part
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        yield a, b, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        a = b


def shingles(hashed: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``width``-word shingles of each text, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(many)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    at = np.arange(total) + np.repeat(first[:-1] - out_first[:-1], many)
    last = np.repeat(first[1:], many)
    acc = np.full(total, _U(0x51ED270B), dtype=np.uint64)
    short = bool((n < width).any())
    for j in range(width):
        w = at + j
        if short:
            inside = w < last
            acc = np.where(inside, mix64(acc * _U(0x9E3779B97F4A7C15) + hashed[np.minimum(w, len(hashed) - 1)]), acc)
        else:
            acc = mix64(acc * _U(0x9E3779B97F4A7C15) + hashed[w])
    for a, b in zip(out_first[:-1].tolist(), out_first[1:].tolist(), strict=True):
        if b - a > 1:
            acc[a:b].sort()
    keep = np.ones(total, dtype=bool)
    keep[1:] = acc[1:] != acc[:-1]
    keep[out_first[:-1][many > 0]] = True
    return acc[keep], np.concatenate([[0], np.cumsum(keep)])[out_first]
