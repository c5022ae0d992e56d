"""Canonical JSON text: sorted keys, no white space, array order kept."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def _number(x: float) -> str:
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        text = f"{mantissa}e{int(exponent)}"
    return text


def _dump(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dump, x)) + "]"
    if isinstance(x, float):
        return _number(x)
    return json.dumps(x, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(name)


def canonical(text: str | None) -> str | None:
    """The canonical text; what doesn't parse (or isn't finite) stays as it is, null stays null."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except (ValueError, RecursionError):
        return text
    return _dump(value)


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _canonical_each(texts: pd.Series) -> pd.Series:
    """The canonical texts; equal texts of a batch are read once."""
    codes, known = pd.factorize(texts)
    done = pd.array([canonical(t) for t in known] + [None], dtype=object)
    return pd.Series(done[codes])


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return _canonical_each(texts)


@F.pandas_udf(BooleanType())
def _same_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x == y for x, y in zip(_canonical_each(a), _canonical_each(b), strict=True)], dtype=object)


def canonical_json(text: Column) -> Column:
    return _canonical_udf(text)


def json_eq(a: Column, b: Column) -> Column:
    """Equal canonical texts; null if either side is a SQL null (JSON null is a value).

    Equal texts are equal as they are; only the others are read, both sides at once.
    """
    unlike = a != b
    read = _same_udf(F.when(unlike, a), F.when(unlike, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(read, F.lit(True)))
