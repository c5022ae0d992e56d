"""Expression nodes.  Columns are positions, not names."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Column:
    index: int


@dataclass(frozen=True)
class Literal:
    """A typed literal; ``token`` None is the untyped NULL, which adopts its neighbour's type."""

    token: str | None
    value: Any = None


@dataclass(frozen=True)
class Add:
    """A sum; ``overload`` names the one the caller insists on, else it is resolved."""

    left: Any
    right: Any
    overload: str | None = None


@dataclass(frozen=True)
class Compare:
    """``op`` "eq" or "lt".  With a collation: a utf8 column against a text."""

    op: str
    left: Any
    right: Any
    collation: str | None = None


@dataclass(frozen=True)
class Cast:
    operand: Any
    token: str


@dataclass(frozen=True)
class IsNotNull:
    """The one predicate; its operand is a column."""

    column: Column


def int32(value: int | None) -> Literal:
    return Literal("int32", value)


def uint64(value: int | None) -> Literal:
    return Literal("uint64", value)


def plus(left: Any, right: Any) -> Add:
    """Another spelling of ``Add``."""
    return Add(left, right)
