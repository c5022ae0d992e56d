"""IEEE comparison and the canonical order of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ieee(a: Column, b: Column, result: Column) -> Column:
    # Spark holds NaN equal to itself and greatest; a null operand still gives null
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(result & ~F.isnan(a) & ~F.isnan(b))


def ieee_eq(a: Column, b: Column) -> Column:
    return _ieee(a, b, a == b)


def ieee_lt(a: Column, b: Column) -> Column:
    return _ieee(a, b, a < b)


def canonical_order(f: Column) -> list[Column]:
    """-Infinity, finite with -0.0 before 0.0, Infinity, NaN; nulls first."""
    return [f.asc_nulls_first(), f.cast("string").asc()]
