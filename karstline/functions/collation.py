"""Two collations: ``binary`` by bytes, ``unicode_ci`` by lower-cased text."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from karstline.errors import CollationError, UnsupportedType
from karstline.plans.types import Field


class Collation(Enum):
    BINARY = "binary"
    UNICODE_CI = "unicode_ci"

    @staticmethod
    def parse(name: str) -> Collation:
        try:
            return Collation(name)
        except ValueError:
            raise CollationError(f"unknown collation {name}") from None

    def key(self, text: Column) -> Column:
        return text if self is Collation.BINARY else F.lower(text)


def check_input(field: Field, what: str) -> None:
    if field.token != "utf8":
        raise UnsupportedType(f"unsupported collation {what} input {field.token}", "unsupported_collation_type")


def compare(op: str, text: Column, other: Column, collation: Collation) -> Column:
    """Null if either side is."""
    a, b = collation.key(text), collation.key(other)
    return a == b if op == "eq" else a < b


def order_keys(text: Column, collation: Collation) -> list[Column]:
    """Ascending, nulls first, ties by raw bytes; a row number behind makes the order stable."""
    return [collation.key(text).asc_nulls_first(), text.asc_nulls_first()]
