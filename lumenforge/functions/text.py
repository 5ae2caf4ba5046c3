"""Text functions that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode White_Space. Fixed values.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(x, F.lit(WHITE))


def dumps(text: str) -> str:
    """JSON with ``", "`` and ``": "``, order and non-ASCII letters kept, numbers as Python writes them."""
    return json.dumps(json.loads(text), ensure_ascii=False)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON number")


def strict_dumps(text: str) -> str:
    """Like ``dumps``, but NaN and Infinity are refused."""
    return json.dumps(json.loads(text, parse_constant=_no_constant), ensure_ascii=False)


def kind_of(text: str) -> str:
    """object, array, string, number, boolean or null."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    return kinds[type(json.loads(text, parse_constant=_no_constant))]


def jinja(value: object) -> str:
    """A value as a template prints it: strings raw, True, False and None by name, containers as JSON."""
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return str(value)
    return json.dumps(value, ensure_ascii=False)


def parameter_block(text: str) -> str | None:
    """The named parameters of a call whose arguments are a JSON object; None for others."""
    value = json.loads(text)
    if not isinstance(value, dict):
        return None
    return "".join(f"<parameter={k}>\n{jinja(v)}\n</parameter>\n" for k, v in value.items())


def or_none(f: Callable[[str], object], text: str) -> object:
    """Its value, or None where the text doesn't parse."""
    try:
        return f(text)
    except (ValueError, TypeError, RecursionError):
        return None


def _mapped(x: pd.Series, f: Callable[[str], object]) -> pd.Series:
    return x.map(lambda v: None if v is None else or_none(f, v))


@F.pandas_udf(StringType())
def json_dumps(x: pd.Series) -> pd.Series:
    """Null where the text isn't JSON."""
    return _mapped(x, dumps)


@F.pandas_udf(StringType())
def json_kind(x: pd.Series) -> pd.Series:
    return _mapped(x, kind_of)


@F.pandas_udf(StringType())
def fmt_1dp(x: pd.Series) -> pd.Series:
    """One decimal place of the exact binary value, half to even."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


@F.pandas_udf(ArrayType(StringType()))
def fmt_1dp_each(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else [f"{t:.1f}" for t in v])


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))
