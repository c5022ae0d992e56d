"""Logical types, fields and schemas, and which surface admits which type.

Spark has no unsigned, JSON-as-text or union types; such a field is carried by
another type and its token kept in the field's metadata.  Types that nothing
can carry (``uint32``, ``decimal256``, ...) exist as declared tokens so that the
analysis can reject them before Spark sees a plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from karstline.errors import InvalidInput, UnsupportedType

TOKEN = "logical_type"
STRUCT, MAP, UNION = "struct<a:int32,b:int32?>", "map<int32,int32?>", "dense_union<i:int32,n:int32?>"

_STRUCT = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.IntegerType())])
_UNION = T.StructType([T.StructField("tag", T.StringType(), False), T.StructField("i", T.IntegerType()), T.StructField("n", T.IntegerType())])
_PLAIN = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "binary": T.BinaryType(), "date32": T.DateType(),
    "timestamp_tz(us)": T.TimestampType(), "timestamp(us)": T.TimestampNTZType(),
}
_CARRIED = {"uint64": T.DecimalType(20, 0), "json": T.StringType(), STRUCT: _STRUCT, MAP: T.MapType(T.IntegerType(), T.IntegerType(), True), UNION: _UNION}


@dataclass(frozen=True)
class Field:
    """A named, typed column as declared: nullability is exact, not what Spark infers."""

    name: str
    token: str
    nullable: bool = True

    @property
    def decimal(self) -> tuple[int, int] | None:
        m = re.fullmatch(r"decimal(?:128|256)?\((\d+),\s*(-?\d+)\)", self.token)
        return (int(m[1]), int(m[2])) if m else None

    @property
    def spark_type(self) -> T.DataType:
        """The type that carries the field; a token that nothing carries is an error."""
        if self.token in _PLAIN:
            return _PLAIN[self.token]
        if self.token in _CARRIED:
            return _CARRIED[self.token]
        if self.decimal and self.token.startswith("decimal128"):
            return T.DecimalType(*self.decimal)
        if self.token == "list<int32>":
            return T.ArrayType(T.IntegerType())
        raise UnsupportedType(f"no Spark type carries {self.token}", rejection(self.token))

    @property
    def metadata(self) -> dict:
        return {TOKEN: self.token} if self.token in _CARRIED else {}

    def renamed(self, name: str) -> Field:
        return replace(self, name=name)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    @staticmethod
    def of(*fields: Field | tuple) -> Schema:
        return Schema(tuple(f if isinstance(f, Field) else Field(*f) for f in fields))

    @staticmethod
    def from_spark(schema: T.StructType) -> Schema:
        return Schema(tuple(Field(f.name, token_of(f), f.nullable) for f in schema.fields))

    def to_spark(self, names: Iterable[str] | None = None) -> T.StructType:
        names = [f.name for f in self.fields] if names is None else list(names)
        return T.StructType([T.StructField(n, f.spark_type, f.nullable, f.metadata) for n, f in zip(names, self.fields, strict=True)])

    def __len__(self) -> int:
        return len(self.fields)


def token_of(field: T.StructField) -> str:
    """The logical token of a Spark field: its metadata, else its type."""
    if TOKEN in (field.metadata or {}):
        return field.metadata[TOKEN]
    kind = field.dataType
    for token, spark in _PLAIN.items():
        if type(kind) is type(spark):
            return token
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision},{kind.scale})"
    for token in (STRUCT, MAP):
        if kind == _CARRIED[token]:
            return token
    if isinstance(kind, T.ArrayType):
        return f"list<{token_of(T.StructField('item', kind.elementType))}>"
    return kind.simpleString()


def check_decimal(field: Field) -> None:
    """Precision 1 to 38 and scale 0 to precision; wider decimals are another family."""
    p, s = field.decimal
    if field.token.startswith("decimal256") or p > 38:
        raise UnsupportedType(f"{field.token} is wider than 38 digits", "unsupported_decimal_type")
    if p < 1 or not 0 <= s <= p:
        raise UnsupportedType(f"{field.token} has no valid precision and scale", "invalid_decimal_metadata")


def rejection(token: str) -> str:
    """The error class of a type that isn't admitted, by its family."""
    if re.match(r"uint(8|16|32)", token):
        return "unsupported_unsigned_family"
    if token.startswith("timestamp_tz("):
        return "unsupported_temporal_unit"
    if re.match(r"timestamp|date64|time|duration|interval", token):
        return "unsupported_temporal_type"
    if token.startswith("decimal"):
        return "unsupported_decimal_type"
    if token.startswith("float"):
        return "unsupported_floating_type"
    if re.match(r"struct|map|dense_union|sparse_union|list|large_list|fixed_size_list|array", token):
        return "unsupported_nested_family"
    return "unsupported_type"


def _family(token: str) -> str:
    return token.split("(")[0]


@dataclass(frozen=True)
class Admission:
    """Families that projections and predicates take; slices of a harness narrow it."""

    project: frozenset[str] = frozenset({"boolean", "int8", "int16", "int32", "int64", "uint64", "float64", "utf8", "json", "binary", "date32", "timestamp_tz", "decimal128", STRUCT, MAP, UNION})
    filter: frozenset[str] = frozenset({"int32", "uint64", "utf8", "json", "date32", "timestamp_tz", "decimal128", "float64"})
    lists: bool = False

    def check_project(self, field: Field) -> None:
        if self.lists and field.token == "list<int32>":
            return
        self._check(field, self.project, rejection(field.token))

    def check_filter(self, field: Field) -> None:
        special = rejection(field.token)
        self._check(field, self.filter, "unsupported_predicate_type" if special == "unsupported_type" else special)

    @staticmethod
    def _check(field: Field, admitted: frozenset[str], error_class: str) -> None:
        if field.decimal:
            check_decimal(field)
        if field.token.startswith("timestamp_tz(") and field.token != "timestamp_tz(us)":
            raise UnsupportedType(f"{field.name}: {field.token} has another unit than us", "unsupported_temporal_unit")
        if _family(field.token) not in admitted and field.token not in admitted:
            raise UnsupportedType(f"{field.name}: {field.token} isn't admitted here", error_class)


DEFAULT_ADMISSION = Admission()


def require_names(names: Iterable[str]) -> None:
    if not list(names):
        raise InvalidInput("a projection needs at least one output")
