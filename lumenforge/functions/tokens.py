"""Tokens by a supplied tokenizer file, loaded once a worker; it is checked by its SHA-256 and never copied.

Byte-level BPE over NFC text, one prompt at a time, without added special tokens or truncation.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lumenforge.plans.errors import ProfileMismatchError


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def check_assets(path: str, sha256: str | None) -> str:
    """The path, if the file is the one asked for."""
    if sha256 and file_hash(path) != sha256:
        raise ProfileMismatchError("the tokenizer file has another hash", path=path)
    return path


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a ``tokenizer.json`` and the bytes of each of its tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = {i for i, _ in t.get_added_tokens_decoder().items()}
    size = np.zeros(t.get_vocab_size(True) + 1, dtype=np.int64)
    for word, i in t.get_vocab(True).items():
        if i < len(size):
            size[i] = len(word.encode()) if i in added else len(word)
    return t, size


def encoded(path: str, text: str) -> tuple[list[int], list[int], str | None]:
    """ids, their byte starts in the NFC text, and an error if their bytes don't add up to it."""
    t, size = load(path)
    ids = t.encode(text, add_special_tokens=False).ids
    ends = np.cumsum(size[ids]) if ids else np.zeros(0, np.int64)
    total = len(unicodedata.normalize("NFC", text).encode())
    return ids, [0, *ends[:-1].tolist()] if ids else [], None if (ends[-1] if ids else 0) == total else "internal_invariant"


#: Texts whose tokens leave a worker at a time.
TEXTS = 256
_TOKENS = StructType([StructField("ids", ArrayType(LongType())), StructField("starts", ArrayType(LongType())), StructField("error", StringType())])


def tokenizer(path: str, sha256: str | None = None):
    """A column function: text -> ids, starts, error."""
    check_assets(path, sha256)

    def one(text: str | None) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
        if text is None:
            return None, None, None
        ids, starts, error = encoded(path, text)
        return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64), error

    @F.pandas_udf(_TOKENS)
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), TEXTS):
                yield pd.DataFrame([one(v) for v in x.iloc[a : a + TEXTS]], columns=["ids", "starts", "error"])

    return tokenize


def decoder(path: str, skip_special: bool = False):
    """A column function: ids -> text."""

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, _ = load(path)
        for x in batches:
            for a in range(0, len(x), TEXTS):
                yield x.iloc[a : a + TEXTS].map(lambda ids: None if ids is None else t.decode(list(map(int, ids)), skip_special_tokens=skip_special))

    return decode


def check_special(path: str, expected: dict[str, int]) -> None:
    """Special texts must be single tokens with the profile's numbers."""
    t, _ = load(path)
    for text, number in expected.items():
        if t.encode(text, add_special_tokens=False).ids != [number]:
            raise ProfileMismatchError("a special token has another number", token=text)


def token_span(starts: list[int], total: int, begin: int, end: int) -> tuple[int, int] | None:
    """Tokens that cover a byte range exactly; None if its edges fall inside tokens."""
    edges = np.append(np.asarray(starts, dtype=np.int64), total)
    a, b = np.searchsorted(edges, begin), np.searchsorted(edges, end)
    return (int(a), int(b)) if b > a and b < len(edges) and edges[a] == begin and edges[b] == end else None
