"""SuperMinHash (Ertl 2017) signatures and their bands, for many sets at once.

Element x meets the slots in the order of its own random permutation: in step j it brings
the value j + r to slot p_j. A slot keeps its least value, so a slot that some element
reached in step j never changes later. Sets with no free slot left are done: that is the
early stop, after two or three steps for sets much larger than the signature.
"""

from __future__ import annotations

import numpy as np

from .textscan import mix64

_U = np.uint64
FREE = np.iinfo(np.uint64).max


def superminhash(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (sets by slots) of the sets ``elements[first[i]:first[i + 1]]``; FREE for empty sets. slots: 256 at most."""
    sets = len(first) - 1
    out = np.full(sets * slots, FREE, dtype=np.uint64)
    of = np.repeat(np.arange(sets), np.diff(first))
    x, perm = elements, None
    for j in range(slots):
        if not len(x):
            break
        r = mix64(x + _U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = (((r >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64) + j
        value = (r & _U(0xFFFFFFFF)) | _U(j << 32)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, of * slots + slot, value)
        open_ = (out.reshape(sets, slots) == FREE).any(axis=1)[of]
        if perm is None:
            x, of, k = x[open_], of[open_], k[open_]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            perm[np.arange(len(x)), k] = 0
        elif open_.mean() < 0.7:
            x, of, perm = x[open_], of[open_], perm[open_]
    return out.reshape(sets, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of equal width."""
    sets, slots = signatures.shape
    parts = signatures.reshape(sets, bands, slots // bands)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95), (sets, bands)).copy()
    for j in range(parts.shape[2]):
        acc = mix64(acc * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return acc
