"""The registry of cases: inputs, operations and expected outcomes, as data."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from karstline.harness.outcomes import Failure, Outcome, Rows
from karstline.plans.types import MAP, STRUCT, UNION, Admission, Field, Schema

INF, NAN = float("inf"), float("nan")
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def _at(*seconds):
    return [(None,) if s is None else (_EPOCH + dt.timedelta(seconds=s),) for s in seconds]


def _day(*days):
    return [(None,) if d is None else (dt.date(1970, 1, 1) + dt.timedelta(days=d),) for d in days]


def _dec(*texts):
    return [(None,) if t is None else (Decimal(t),) for t in texts]


def _one(*values):
    return [(v,) for v in values]


def _zone(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def _two(left: str, right: str, nullable: bool = False, names: tuple[str, str] = ("lhs", "rhs")) -> Schema:
    return Schema.of((names[0], left, nullable), (names[1], right, nullable))


U64 = 2**64 - 1
# Names, types and rows of the shared inputs.
INPUTS: dict[str, tuple[Schema, list[tuple] | None]] = {
    "first-expression-slice-int32-basic": (Schema.of(("a", "int32", False)), _one(1, 2, 3)),
    "first-expression-slice-int32-nullable": (Schema.of(("a", "int32")), _one(1, None, 3)),
    "first-expression-slice-int32-overflow": (Schema.of(("a", "int32", False)), _one(2147483647)),
    "first-filter-is-not-null-int32-basic": (Schema.of(("a", "int32", False)), _one(1, 2, 3)),
    "first-filter-is-not-null-int32-all-null": (Schema.of(("a", "int32")), _one(None, None, None)),
    "first-filter-is-not-null-int32-mixed-two-column": (Schema.of(("a", "int32"), ("b", "int32", False)), [(1, 10), (None, 20), (3, 30), (None, 40)]),
    "first-filter-is-not-null-utf8-basic": (Schema.of(("s", "utf8", False)), _one("x", "y", "z")),
    "first-uint64-basic": (Schema.of(("u", "uint64", False)), _dec("0", "7", "42")),
    "first-uint64-nullable": (Schema.of(("u", "uint64")), _dec(None, "5", None, "9")),
    "first-uint64-add-basic": (_two("uint64", "uint64"), [(Decimal(a), Decimal(b)) for a, b in ((1, 2), (3, 4), (10, 20))]),
    "first-uint64-add-nullable": (_two("uint64", "uint64", True), [(None, Decimal(1)), (Decimal(2), None), (Decimal(3), Decimal(4))]),
    "first-uint64-add-overflow": (_two("uint64", "uint64"), [(Decimal(U64), Decimal(1))]),
    "first-mixed-int64-uint64": (Schema.of(("s", "int64", False), ("u", "uint64", False)), [(1, Decimal(1))]),
    "first-uint32-basic": (Schema.of(("u32", "uint32", False)), None),
    "first-float64-basic": (Schema.of(("f", "float64", False)), _one(-1.5, 0.0, 2.25)),
    "first-float64-special-values": (Schema.of(("f", "float64", False)), _one(-INF, -0.0, 0.0, INF, NAN)),
    "first-float64-nullable-special-values": (Schema.of(("f", "float64")), _one(None, -INF, None, NAN, 1.0)),
    "first-float64-ordering-scramble": (Schema.of(("f", "float64", False)), _one(NAN, 1.0, -INF, INF, 0.0, -0.0)),
    "first-float32-basic": (Schema.of(("f32", "float32", False)), _one(1.5, 0.0, -2.25)),
    "first-decimal128-basic": (Schema.of(("d", "decimal128(10,2)", False)), _dec("1.00", "2.50", "-3.75")),
    "first-decimal128-nullable": (Schema.of(("d", "decimal128(10,2)")), _dec("1.00", None, "-3.75", None)),
    "first-decimal128-all-null": (Schema.of(("d", "decimal128(10,2)")), _dec(None, None, None)),
    "first-decimal256-basic": (Schema.of(("d256", "decimal256(40,4)", False)), None),
    "first-decimal128-invalid-scale": (Schema.of(("d_bad", "decimal128(10,12)", False)), None),
    "first-temporal-date32-basic": (Schema.of(("d", "date32", False)), _day(0, 1, 2)),
    "first-temporal-date32-nullable": (Schema.of(("d", "date32")), _day(0, None, 2, None)),
    "first-temporal-date32-all-null": (Schema.of(("d", "date32")), _day(None, None, None)),
    "first-temporal-timestamp-basic": (Schema.of(("ts", "timestamp(us)", False)), _one(*[dt.datetime(1970, 1, d) for d in (1, 2, 3)])),
    "first-temporal-timestamp-tz-basic": (Schema.of(("ts", "timestamp_tz(us)", False)), _at(0, 1, 2)),
    "first-temporal-timestamp-tz-equivalent-instants": (Schema.of(("ts", "timestamp_tz(us)", False)), _one(*map(_zone, ("2024-01-01T00:00:00+00:00", "2023-12-31T19:00:00-05:00", "2024-01-01T09:00:00+09:00")))),
    "first-temporal-timestamp-tz-nullable": (Schema.of(("ts", "timestamp_tz(us)")), _at(0, None, 2, None)),
    "first-temporal-timestamp-tz-all-null": (Schema.of(("ts", "timestamp_tz(us)")), _at(None, None, None)),
    "first-temporal-timestamp-naive-basic": (Schema.of(("ts", "timestamp(us)", False)), _one(*[dt.datetime(1970, 1, d) for d in (1, 2, 3)])),
    "first-temporal-timestamp-tz-ms-basic": (Schema.of(("ts", "timestamp_tz(ms)", False)), None),
    "first-utf8-basic": (Schema.of(("s", "utf8", False)), _one("Alpha", "alpha", "beta")),
    "first-utf8-nullable": (Schema.of(("s", "utf8")), _one("Alpha", None, "beta")),
    "first-utf8-ordering": (Schema.of(("s", "utf8", False)), _one("b", "A", "a", "B")),
    "first-int32-basic": (Schema.of(("x", "int32", False)), _one(1, 2, 3)),
    "first-json-basic": (Schema.of(("j", "json", False)), _one('{"a":1}', "[1,2]", "true")),
    "first-json-nullable": (Schema.of(("j", "json")), _one('{"a":1}', None, "null", '{"b":2,"a":1}')),
    "first-json-all-null": (Schema.of(("j", "json")), _one(None, None, None)),
    "first-json-array-order": (Schema.of(("j", "json", False)), _one("[1,2]", "[2,1]")),
    "first-utf8-json-text": (Schema.of(("s", "utf8", False)), _one('{"a":1}')),
    "first-struct-basic": (Schema.of(("s", STRUCT, False)), _one((1, 2), (3, 4), (5, 6))),
    "first-struct-nullable": (Schema.of(("s", STRUCT)), _one((1, None), None, (2, 3))),
    "first-map-basic": (Schema.of(("m", MAP, False)), _one({1: 2, 3: 4}, {5: 6}, {})),
    "first-map-nullable": (Schema.of(("m", MAP)), _one({1: None}, None, {2: 3})),
    "first-union-basic": (Schema.of(("u", UNION, False)), _one(("i", 1, None), ("n", None, 2), ("i", 3, None))),
    "first-union-nullable-variant": (Schema.of(("u", UNION, False)), _one(("n", None, None), ("i", 4, None), ("n", None, 5))),
    "first-int64-basic": (Schema.of(("s64", "int64", False)), _one(-7, 0, 42)),
    "first-int64-add-basic": (_two("int64", "int64"), [(1, 2), (-3, 4), (10, 20)]),
    "first-int64-add-nullable": (_two("int64", "int64", True), [(None, 1), (2, None), (-3, 4)]),
    "first-int32-int64-add-basic": (_two("int32", "int64", names=("lhs32", "rhs64")), [(1, 2), (-3, 4), (100, 200)]),
    "first-int64-int32-add-basic": (_two("int64", "int32", names=("lhs64", "rhs32")), [(2, 1), (4, -3), (200, 100)]),
    "first-int64-add-overflow": (_two("int64", "int64"), [(2**63 - 1, 1)]),
    "first-int32-int64-add-overflow": (_two("int32", "int64", names=("lhs32", "rhs64")), [(1, 2**63 - 1)]),
    "first-float64-add-basic": (_two("float64", "float64"), [(1.5, 2.25), (-3.0, 4.5), (0.25, 0.75)]),
    "first-float64-add-nullable": (_two("float64", "float64", True), [(None, 1.0), (2.5, None), (-3.0, 4.5)]),
    "first-float64-add-special-values": (_two("float64", "float64"), [(INF, 1.0), (-INF, INF), (NAN, 2.0), (-0.0, -0.0)]),
    "first-int32-float64-add-basic": (_two("int32", "float64"), [(1, 2.25), (-3, 4.5), (7, 0.5)]),
    "first-int64-float64-add-basic": (_two("int64", "float64"), [(1, 2.25), (-3, 4.5), (10**12, 0.5)]),
    "first-float64-int32-add-basic": (_two("float64", "int32"), [(2.25, 1), (4.5, -3), (0.5, 7)]),
    "first-float64-int64-add-basic": (_two("float64", "int64"), [(2.25, 1), (4.5, -3), (1.0, 10**12)]),
}


@dataclass(frozen=True)
class Case:
    """``operation`` is a reference such as ``column-0`` or ``is-not-null-column-0``."""

    slice_id: str
    case_id: str
    input_ref: str
    operation: str
    expected: Outcome
    collation: str | None = None
    mode: str = "row-order-preserved"


#: What a slice admits, where that is narrower than the library.
SLICE_ADMISSION = {
    "first-filter-is-not-null-slice": Admission(filter=frozenset({"int32"})),
    "first-struct-slice": Admission(project=frozenset({STRUCT})),
    "first-map-slice": Admission(project=frozenset({MAP})),
    "first-union-slice": Admission(project=frozenset({UNION})),
}


def _rows(name: str, token: str, nullable: bool, *values) -> Rows:
    return Rows((Field(name, token, nullable),), tuple((v,) for v in values))


def _error(error_class: str) -> Failure:
    return Failure(error_class)


def _slice(slice_id: str, *cases: tuple) -> list[Case]:
    return [Case(slice_id, *c) for c in cases]


_MISSING = _error("missing_column")
TS, D = "timestamp_tz(us)", "decimal128(10,2)"
_J = ('{"a":1}', "[1,2]", "true")
# Case names, inputs, operations and stated outcomes, slice by slice.
CASES: list[Case] = [
    *_slice(
        "first-expression-slice",
        ("column-passthrough", "first-expression-slice-int32-basic", "column-a", _rows("a", "int32", False, 1, 2, 3)),
        ("literal-int32-seven", "first-expression-slice-int32-basic", "literal-int32-seven", _rows("lit", "int32", False, 7, 7, 7)),
        ("literal-int32-null", "first-expression-slice-int32-basic", "literal-int32-null", _rows("lit", "int32", True, None, None, None)),
        ("add-int32-literal", "first-expression-slice-int32-basic", "add-a-plus-one", _rows("a_plus_one", "int32", False, 2, 3, 4)),
        ("add-int32-null-propagation", "first-expression-slice-int32-nullable", "add-a-plus-one", _rows("a_plus_one", "int32", True, 2, None, 4)),
        ("add-int32-overflow-error", "first-expression-slice-int32-overflow", "add-a-plus-one", _error("arithmetic_overflow")),
    ),
    *_slice(
        "first-filter-is-not-null-slice",
        ("all-rows-kept", "first-filter-is-not-null-int32-basic", "is-not-null-column-0", _rows("a", "int32", False, 1, 2, 3)),
        ("all-rows-dropped", "first-filter-is-not-null-int32-all-null", "is-not-null-column-0", _rows("a", "int32", True)),
        ("mixed-keep-drop", "first-filter-is-not-null-int32-mixed-two-column", "is-not-null-column-0", Rows((Field("a", "int32"), Field("b", "int32", False)), ((1, 10), (3, 30)))),
        ("missing-column-error", "first-filter-is-not-null-int32-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-predicate-type-error", "first-filter-is-not-null-utf8-basic", "is-not-null-column-0", _error("unsupported_predicate_type")),
    ),
    *_slice(
        "first-temporal-date32-slice",
        ("date32-column-passthrough", "first-temporal-date32-basic", "column-0", _rows("d", "date32", False, 0, 1, 2)),
        ("date32-column-null-preserve", "first-temporal-date32-nullable", "column-0", _rows("d", "date32", True, 0, None, 2, None)),
        ("date32-is-not-null-all-kept", "first-temporal-date32-basic", "is-not-null-column-0", _rows("d", "date32", False, 0, 1, 2)),
        ("date32-is-not-null-all-dropped", "first-temporal-date32-all-null", "is-not-null-column-0", _rows("d", "date32", True)),
        ("date32-is-not-null-mixed-keep-drop", "first-temporal-date32-nullable", "is-not-null-column-0", _rows("d", "date32", True, 0, 2)),
        ("date32-missing-column-error", "first-temporal-date32-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-temporal-type-error", "first-temporal-timestamp-basic", "column-0", _error("unsupported_temporal_type")),
    ),
    *_slice(
        "first-temporal-timestamp-tz-slice",
        ("timestamp-tz-column-passthrough", "first-temporal-timestamp-tz-basic", "column-0", _rows("ts", TS, False, 0, 1_000_000, 2_000_000)),
        ("timestamp-tz-equivalent-instant-normalization", "first-temporal-timestamp-tz-equivalent-instants", "column-0", _rows("ts", TS, False, *[1_704_067_200_000_000] * 3)),
        ("timestamp-tz-column-null-preserve", "first-temporal-timestamp-tz-nullable", "column-0", _rows("ts", TS, True, 0, None, 2_000_000, None)),
        ("timestamp-tz-is-not-null-all-kept", "first-temporal-timestamp-tz-basic", "is-not-null-column-0", _rows("ts", TS, False, 0, 1_000_000, 2_000_000)),
        ("timestamp-tz-is-not-null-all-dropped", "first-temporal-timestamp-tz-all-null", "is-not-null-column-0", _rows("ts", TS, True)),
        ("timestamp-tz-is-not-null-mixed-keep-drop", "first-temporal-timestamp-tz-nullable", "is-not-null-column-0", _rows("ts", TS, True, 0, 2_000_000)),
        ("timestamp-tz-order-asc-nulls-last", "first-temporal-timestamp-tz-nullable", "order-by-column-0-asc-nulls-last", _rows("ts", TS, True, 0, 2_000_000, None, None)),
        ("timestamp-tz-missing-column-error", "first-temporal-timestamp-tz-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-temporal-timestamp-without-timezone-error", "first-temporal-timestamp-naive-basic", "column-0", _error("unsupported_temporal_type")),
        ("unsupported-temporal-timestamp-unit-error", "first-temporal-timestamp-tz-ms-basic", "column-0", _error("unsupported_temporal_unit")),
    ),
    *_slice(
        "first-decimal128-slice",
        ("decimal128-column-passthrough", "first-decimal128-basic", "column-0", _rows("d", D, False, "1.00", "2.50", "-3.75")),
        ("decimal128-column-null-preserve", "first-decimal128-nullable", "column-0", _rows("d", D, True, "1.00", None, "-3.75", None)),
        ("decimal128-is-not-null-all-kept", "first-decimal128-basic", "is-not-null-column-0", _rows("d", D, False, "1.00", "2.50", "-3.75")),
        ("decimal128-is-not-null-all-dropped", "first-decimal128-all-null", "is-not-null-column-0", _rows("d", D, True)),
        ("decimal128-is-not-null-mixed-keep-drop", "first-decimal128-nullable", "is-not-null-column-0", _rows("d", D, True, "1.00", "-3.75")),
        ("decimal128-missing-column-error", "first-decimal128-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-decimal-type-error", "first-decimal256-basic", "column-0", _error("unsupported_decimal_type")),
        ("invalid-decimal-metadata-error", "first-decimal128-invalid-scale", "column-0", _error("invalid_decimal_metadata")),
    ),
    *_slice(
        "first-float64-ordering-slice",
        ("float64-column-passthrough", "first-float64-basic", "column-0", _rows("f", "float64", False, "-1.5", "0.0", "2.25")),
        ("float64-special-values-passthrough", "first-float64-special-values", "column-0", _rows("f", "float64", False, "-Infinity", "-0.0", "0.0", "Infinity", "NaN")),
        ("float64-is-not-null-all-kept", "first-float64-special-values", "is-not-null-column-0", _rows("f", "float64", False, "-Infinity", "-0.0", "0.0", "Infinity", "NaN")),
        ("float64-is-not-null-mixed-keep-drop", "first-float64-nullable-special-values", "is-not-null-column-0", _rows("f", "float64", True, "-Infinity", "NaN", "1.0")),
        ("float64-canonical-ordering-normalization", "first-float64-ordering-scramble", "column-0", _rows("f", "float64", False, "-Infinity", "-0.0", "0.0", "1.0", "Infinity", "NaN"), None, "float64-multiset-canonical"),
        ("float64-missing-column-error", "first-float64-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-floating-type-error", "first-float32-basic", "column-0", _error("unsupported_floating_type")),
    ),
    *_slice(
        "first-unsigned-arithmetic-slice",
        ("uint64-column-passthrough", "first-uint64-basic", "column-0", _rows("u", "uint64", False, "0", "7", "42")),
        ("uint64-literal-projection", "first-uint64-basic", "literal-uint64-7", _rows("lit", "uint64", False, "7", "7", "7")),
        ("uint64-add-basic", "first-uint64-add-basic", "add-uint64-column-0-column-1", _rows("sum", "uint64", False, "3", "7", "30")),
        ("uint64-add-null-propagation", "first-uint64-add-nullable", "add-uint64-column-0-column-1", _rows("sum", "uint64", True, None, None, "7")),
        ("uint64-add-overflow-error", "first-uint64-add-overflow", "add-uint64-column-0-column-1", _error("unsigned_overflow")),
        ("uint64-is-not-null-mixed-keep-drop", "first-uint64-nullable", "is-not-null-column-0", _rows("u", "uint64", True, "5", "9")),
        ("uint64-missing-column-error", "first-uint64-basic", "column-2", _MISSING),
        ("mixed-signed-unsigned-arithmetic-error", "first-mixed-int64-uint64", "add-uint64-column-0-column-1", _error("mixed_signed_unsigned")),
        ("unsupported-unsigned-family-error", "first-uint32-basic", "column-0", _error("unsupported_unsigned_family")),
    ),
    *_slice(
        "first-json-slice",
        ("json-column-passthrough", "first-json-basic", "column-0", _rows("j", "json", False, *_J)),
        ("json-column-null-preserve", "first-json-nullable", "column-0", _rows("j", "json", True, '{"a":1}', None, "null", '{"a":1,"b":2}')),
        ("json-object-canonicalization", "first-json-nullable", "column-0", _rows("j", "json", True, '{"a":1}', None, "null", '{"a":1,"b":2}')),
        ("json-array-order-preserved", "first-json-array-order", "column-0", _rows("j", "json", False, "[1,2]", "[2,1]")),
        ("json-is-not-null-all-kept", "first-json-basic", "is-not-null-column-0", _rows("j", "json", False, *_J)),
        ("json-is-not-null-all-dropped", "first-json-all-null", "is-not-null-column-0", _rows("j", "json", True)),
        ("json-is-not-null-mixed-keep-drop", "first-json-nullable", "is-not-null-column-0", _rows("j", "json", True, '{"a":1}', "null", '{"a":1,"b":2}')),
        ("json-missing-column-error", "first-json-basic", "is-not-null-column-1", _MISSING),
        ("unsupported-json-ordering-comparison-error", "first-json-basic", "less-than-column-0-column-0", _error("unsupported_json_comparison")),
        ("unsupported-json-cast-error", "first-json-basic", "json-column-0-to-int32", _error("unsupported_json_cast")),
        ("unsupported-cast-to-json-error", "first-utf8-json-text", "utf8-column-0-to-json", _error("unsupported_json_cast")),
    ),
    *_slice(
        "first-collation-string-slice",
        ("utf8-column-passthrough-binary", "first-utf8-basic", "column-0", _rows("s", "utf8", False, "Alpha", "alpha", "beta"), "binary"),
        ("utf8-column-passthrough-unicode-ci", "first-utf8-basic", "column-0", _rows("s", "utf8", False, "Alpha", "alpha", "beta"), "unicode_ci"),
        ("utf8-is-not-null-mixed-keep-drop", "first-utf8-nullable", "is-not-null-column-0", _rows("s", "utf8", True, "Alpha", "beta"), "binary"),
        ("utf8-binary-eq-literal-alpha", "first-utf8-basic", "eq-column-0-literal-alpha", _rows("comparison", "boolean", False, False, True, False), "binary"),
        ("utf8-unicode-ci-eq-literal-alpha", "first-utf8-basic", "eq-column-0-literal-alpha", _rows("comparison", "boolean", False, True, True, False), "unicode_ci"),
        ("utf8-binary-lt-literal-beta", "first-utf8-basic", "lt-column-0-literal-beta", _rows("comparison", "boolean", False, True, True, False), "binary"),
        ("utf8-unicode-ci-ordering-normalization", "first-utf8-ordering", "order-by-column-0-asc", _rows("s", "utf8", False, "A", "a", "B", "b"), "unicode_ci"),
        ("utf8-missing-column-error", "first-utf8-basic", "is-not-null-column-1", _MISSING, "binary"),
        ("unknown-collation-error", "first-utf8-basic", "eq-column-0-literal-alpha", _error("unknown_collation"), "unknown-collation"),
        ("unsupported-collation-type-error", "first-int32-basic", "eq-column-0-literal-alpha", _error("unsupported_collation_type"), "binary"),
    ),
    *_slice(
        "first-struct-slice",
        ("struct-column-passthrough", "first-struct-basic", "column-0", _rows("s", STRUCT, False, {"a": 1, "b": 2}, {"a": 3, "b": 4}, {"a": 5, "b": 6})),
        ("struct-column-null-preserve", "first-struct-nullable", "column-0", _rows("s", STRUCT, True, {"a": 1, "b": None}, None, {"a": 2, "b": 3})),
        ("struct-child-null-preserve", "first-struct-nullable", "column-0", _rows("s", STRUCT, True, {"a": 1, "b": None}, None, {"a": 2, "b": 3})),
        ("struct-missing-column-error", "first-struct-basic", "column-1", _MISSING),
        ("unsupported-nested-family-error", "first-map-basic", "column-0", _error("unsupported_nested_family")),
    ),
    *_slice(
        "first-map-slice",
        ("map-column-passthrough", "first-map-basic", "column-0", _rows("m", MAP, False, [{"key": 1, "value": 2}, {"key": 3, "value": 4}], [{"key": 5, "value": 6}], [])),
        ("map-column-null-preserve", "first-map-nullable", "column-0", _rows("m", MAP, True, [{"key": 1, "value": None}], None, [{"key": 2, "value": 3}])),
        ("map-value-null-preserve", "first-map-nullable", "column-0", _rows("m", MAP, True, [{"key": 1, "value": None}], None, [{"key": 2, "value": 3}])),
        ("map-missing-column-error", "first-map-basic", "column-1", _MISSING),
        ("unsupported-nested-family-error", "first-union-basic", "column-0", _error("unsupported_nested_family")),
    ),
    *_slice(
        "first-union-slice",
        ("union-column-passthrough", "first-union-basic", "column-0", _rows("u", UNION, False, {"tag": "i", "value": 1}, {"tag": "n", "value": 2}, {"tag": "i", "value": 3})),
        ("union-variant-switch-preserve", "first-union-basic", "column-0", _rows("u", UNION, False, {"tag": "i", "value": 1}, {"tag": "n", "value": 2}, {"tag": "i", "value": 3})),
        ("union-variant-null-preserve", "first-union-nullable-variant", "column-0", _rows("u", UNION, False, {"tag": "n", "value": None}, {"tag": "i", "value": 4}, {"tag": "n", "value": 5})),
        ("union-missing-column-error", "first-union-basic", "column-1", _MISSING),
        ("unsupported-nested-family-error", "first-map-basic", "column-0", _error("unsupported_nested_family")),
    ),
    *_slice(
        "first-signed-widening-add-int64-slice",
        ("int64-column-passthrough", "first-int64-basic", "column-0", _rows("s64", "int64", False, -7, 0, 42)),
        ("int64-add-basic", "first-int64-add-basic", "add-int64-column-0-column-1", _rows("sum", "int64", False, 3, 1, 30)),
        ("int64-add-null-propagation", "first-int64-add-nullable", "add-int64-column-0-column-1", _rows("sum", "int64", True, None, None, 1)),
        ("signed-widening-int32-plus-int64", "first-int32-int64-add-basic", "add-int64-column-0-column-1", _rows("sum", "int64", False, 3, 1, 300)),
        ("signed-widening-int64-plus-int32", "first-int64-int32-add-basic", "add-int64-column-0-column-1", _rows("sum", "int64", False, 3, 1, 300)),
        ("int64-add-overflow-error", "first-int64-add-overflow", "add-int64-column-0-column-1", _error("arithmetic_overflow")),
        ("signed-widening-int32-plus-int64-overflow-error", "first-int32-int64-add-overflow", "add-int64-column-0-column-1", _error("arithmetic_overflow")),
        ("int64-missing-column-error", "first-int64-basic", "column-1", _MISSING),
    ),
    *_slice(
        "first-widening-add-float64-slice",
        ("float64-column-passthrough", "first-float64-basic", "column-0", _rows("f", "float64", False, "-1.5", "0.0", "2.25")),
        ("float64-add-basic", "first-float64-add-basic", "add-float64-column-0-column-1", _rows("sum", "float64", False, "3.75", "1.5", "1.0")),
        ("float64-add-null-propagation", "first-float64-add-nullable", "add-float64-column-0-column-1", _rows("sum", "float64", True, None, None, "1.5")),
        ("float64-add-special-values", "first-float64-add-special-values", "add-float64-column-0-column-1", _rows("sum", "float64", False, "Infinity", "NaN", "NaN", "-0.0")),
        ("widening-int32-plus-float64", "first-int32-float64-add-basic", "add-float64-column-0-column-1", _rows("sum", "float64", False, "3.25", "1.5", "7.5")),
        ("widening-int64-plus-float64", "first-int64-float64-add-basic", "add-float64-column-0-column-1", _rows("sum", "float64", False, "3.25", "1.5", "1000000000000.5")),
        ("widening-float64-plus-int32", "first-float64-int32-add-basic", "add-float64-column-0-column-1", _rows("sum", "float64", False, "3.25", "1.5", "7.5")),
        ("widening-float64-plus-int64", "first-float64-int64-add-basic", "add-float64-column-0-column-1", _rows("sum", "float64", False, "3.25", "1.5", "1000000000001.0")),
        ("float64-add-missing-column-error", "first-float64-basic", "column-1", _MISSING),
    ),
]


def slice_ids() -> list[str]:
    return list(dict.fromkeys(c.slice_id for c in CASES))
