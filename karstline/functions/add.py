"""One add family: overload resolution, then a policy for each overload."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from karstline.errors import OverloadError
from karstline.plans.types import Field

UINT64_MAX = 2**64 - 1
#: Widening order; nothing else is coerced.
LADDER = ("int32", "int64", "float64")
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
SIGNED = ("int8", "int16", "int32", "int64")
# Protocol identifiers of the sum of each number family.
PROTOCOL_IDS = {"float64": 200, "decimal128": 201, "int64": 203, "int32": 203, "uint64": 203}


@dataclass(frozen=True)
class Overload:
    token: str
    lower: Callable[[Column, Column], Column]


def _sum_uint64(left: Column, right: Column) -> Column:
    # decimal(20,0) holds more than 64 bits, so the guard is explicit
    total = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
    bad = F.raise_error(F.lit("UNSIGNED_OVERFLOW")).cast("decimal(21,0)")
    return F.when(total > F.lit(Decimal(UINT64_MAX)), bad).otherwise(total).cast("decimal(20,0)")


_POLICY = {
    "int32": lambda a, b: a.cast("int") + b.cast("int"),
    "int64": lambda a, b: a.cast("bigint") + b.cast("bigint"),
    "float64": lambda a, b: a.cast("double") + b.cast("double"),
    "uint64": _sum_uint64,
}


def decimal_result(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """Precision and scale of a sum; over 38 digits the sum isn't admitted."""
    (p1, s1), (p2, s2) = left, right
    s = max(s1, s2)
    p = max(p1 - s1, p2 - s2) + s + 1
    if p > 38:
        raise OverloadError(f"decimal({p1},{s1}) + decimal({p2},{s2}) needs {p} digits", "unsupported_decimal_type")
    return p, s


def resolve(left: Field | None, right: Field | None) -> Overload:
    """The overload of two operands; None is the untyped NULL, which adopts the other's type.

    An exact overload first, else the least common type of the ladder.  Signed and
    unsigned never mix, decimals take nothing else in.
    """
    if left is None and right is None:
        raise OverloadError("NULL + NULL has no type")
    left, right = left or right, right or left
    pair = (left.token, right.token)
    if left.decimal and right.decimal:
        p, s = decimal_result(left.decimal, right.decimal)
        return Overload(f"decimal128({p},{s})", lambda a, b: (a + b).cast(f"decimal({p},{s})"))
    signs = {t in UNSIGNED for t in pair if t in UNSIGNED or t in SIGNED}
    if len(signs) == 2:
        raise OverloadError(f"{pair[0]} + {pair[1]} mixes signed and unsigned", "mixed_signed_unsigned")
    if any(t in UNSIGNED and t != "uint64" for t in pair):
        raise OverloadError(f"{pair[0]} + {pair[1]} isn't admitted", "unsupported_unsigned_family")
    if pair == ("uint64", "uint64"):
        return Overload("uint64", _POLICY["uint64"])
    if all(t in LADDER for t in pair):
        token = LADDER[max(map(LADDER.index, pair))]
        return Overload(token, _POLICY[token])
    floating = any(t == "float32" for t in pair)
    raise OverloadError(f"{pair[0]} + {pair[1]} isn't admitted", "unsupported_floating_type" if floating else None)


def require(overload: str, left: Field | None, right: Field | None) -> Overload:
    """The overload that the caller names: its operands must be exactly of its type."""
    found = resolve(left, right)
    exact = {f.token for f in (left, right) if f is not None} <= {overload}
    if found.token != overload or (not exact and overload in ("int32", "uint64")):
        raise OverloadError(f"add<{overload}> doesn't take {left and left.token} and {right and right.token}")
    return found
