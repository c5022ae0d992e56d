import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest
from karstline import operators as ops
from karstline.errors import CollationError, InvalidInput, JsonError, MissingColumn, OverloadError, UnsupportedType, classify
from karstline.functions import add
from karstline.plans.expr import Add, Cast, Column, Compare, IsNotNull, Literal, int32, plus, uint64
from karstline.plans.table import Pipeline, Table
from karstline.plans.types import MAP, STRUCT, UNION, Admission, Field, Schema, token_of
from karstline.sources import from_arrow, from_rows, read_parquet, write_parquet
from pyspark.sql import types as T


def table(spark, *fields, rows=()):
    return from_rows(spark, Schema.of(*fields), list(rows))


def error_class(call, *args, **kwargs):
    with pytest.raises(Exception) as found:  # noqa: PT011
        call(*args, **kwargs)
    return classify(found.value)


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("int32", "int32", "int32"), ("int32", "int64", "int64"), ("int64", "int32", "int64"), ("int64", "int64", "int64"),
        ("int32", "float64", "float64"), ("float64", "int64", "float64"), ("float64", "float64", "float64"), ("uint64", "uint64", "uint64"),
        ("decimal128(12,2)", "decimal128(12,2)", "decimal128(13,2)"), ("decimal128(10,2)", "decimal128(8,4)", "decimal128(13,4)"),
    ],
)
def test_overloads(left, right, want):
    assert add.resolve(Field("a", left), Field("b", right)).token == want


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("int64", "uint64", "mixed_signed_unsigned"), ("uint32", "uint32", "unsupported_unsigned_family"), ("uint64", "int8", "mixed_signed_unsigned"),
        ("decimal128(38,2)", "decimal128(38,4)", "unsupported_decimal_type"), ("decimal128(10,2)", "int32", "unsupported_arithmetic_type"),
        ("decimal128(10,2)", "float64", "unsupported_arithmetic_type"), ("uint64", "float64", "unsupported_arithmetic_type"),
        ("float32", "float64", "unsupported_floating_type"), ("boolean", "int32", "unsupported_arithmetic_type"),
    ],
)
def test_no_overload(left, right, want):
    assert error_class(add.resolve, Field("a", left), Field("b", right)) == want


def test_untyped_null_adopts_the_other_type(spark):
    t = table(spark, ("a", "int64", False), rows=[(1,), (2,)])
    out = ops.project(t, [("x", Add(Column(0), Literal(None)))])
    assert out.schema.fields[0] == Field("x", "int64", True) and ops.collect(out) == [(None,), (None,)]
    assert error_class(ops.project, t, [("x", Add(Literal(None), Literal(None)))]) == "unsupported_arithmetic_type"


def test_nested_sums_nullability_and_duplicate_names(spark):
    t = table(spark, ("a", "int32", False), ("b", "int32"), rows=[(1, None), (2, 5)])
    out = ops.project(t, [("x", plus(plus(Column(0), int32(1)), Column(0))), ("x", Add(Column(0), Column(1), "int32")), ("a", Column(0))])
    assert [(f.name, f.token, f.nullable) for f in out.schema.fields] == [("x", "int32", False), ("x", "int32", True), ("a", "int32", False)]
    assert ops.collect(out) == [(3, None, 1), (5, 7, 2)]
    assert out.to_df().columns == ["x", "x", "a"]


def test_all_types_are_checked_before_any_row(spark):
    t = table(spark, ("a", "int32", False), rows=[(2**31 - 1,)])
    with pytest.raises(MissingColumn):
        ops.project(t, [("x", Add(Column(0), int32(1))), ("y", Column(7))], strict=True)
    with pytest.raises(InvalidInput):
        ops.project(t, [])
    with pytest.raises(OverloadError):
        ops.project(t, [("x", Add(Column(0), uint64(1), "int32"))])
    with pytest.raises(InvalidInput):
        ops.project(t, [("x", int32(2**31))])


def test_strict_projections_raise_where_lax_ones_may_not(spark):
    t = table(spark, ("a", "int32"), ("b", "int32", False), rows=[(None, 2**31 - 1), (1, 1)])
    outputs = [("a", Column(0)), ("s", Add(Column(1), int32(1)))]
    assert ops.collect(ops.filter_not_null(ops.project(t, outputs), 0)) == [(1, 2)]
    assert error_class(ops.project, t, outputs, strict=True) == "arithmetic_overflow"


def test_uint64_edges(spark):
    most = Decimal(2**64 - 1)
    t = table(spark, ("a", "uint64", False), ("b", "uint64"), rows=[(most, Decimal(0)), (most, None)])
    out = ops.project(t, [("s", Add(Column(0), Column(1)))])
    assert ops.collect(out) == [(most,), (None,)]
    assert token_of(out.to_df().schema[0]) == "uint64"
    over = table(spark, ("a", "uint64", False), rows=[(most,)])
    assert error_class(ops.collect, ops.project(over, [("s", Add(Column(0), uint64(1)))])) == "unsigned_overflow"


@pytest.mark.parametrize("token", ["int32", "uint64", "utf8", "json", "date32", "timestamp_tz(us)", "decimal128(10,2)", "float64"])
def test_filter_admits(spark, token):
    t = table(spark, ("v", token), rows=[(None,)])
    assert ops.collect(ops.filter_not_null(t, 0)) == []


@pytest.mark.parametrize(
    ("token", "want"),
    [("int64", "unsupported_predicate_type"), ("boolean", "unsupported_predicate_type"), (STRUCT, "unsupported_nested_family"), (MAP, "unsupported_nested_family"), ("timestamp(us)", "unsupported_temporal_type")],
)
def test_filter_rejects(spark, token, want):
    assert error_class(ops.filter_not_null, table(spark, ("v", token)), 0) == want


def test_filter_keeps_nan_and_json_null(spark):
    t = table(spark, ("f", "float64"), ("j", "json"), rows=[(float("nan"), "null"), (None, None)])
    assert ops.collect(ops.filter_not_null(t, 0))[0][1] == "null" and len(ops.collect(ops.filter_not_null(t, 1))) == 1


def test_other_error_classes(spark):
    t = table(spark, ("s", "utf8"), ("j", "json"), ("x", "int32"), rows=[("a", "1", 1)])
    for expression, kind in (
        (Compare("eq", Column(0), "a", "nocase"), CollationError), (Compare("eq", Column(2), "a", "binary"), UnsupportedType), (Compare("lt", Column(1), Column(1)), JsonError),
        (Compare("eq", Column(1), Column(0)), JsonError), (Compare("eq", Column(0), Column(0)), UnsupportedType), (Cast(Column(0), "json"), JsonError), (Cast(Column(0), "int32"), UnsupportedType),
        (Literal("utf8", "x"), UnsupportedType), (Literal(None), OverloadError), ("nonsense", InvalidInput),
    ):
        with pytest.raises(kind):
            ops.project(t, [("x", expression)])
    with pytest.raises(InvalidInput):
        ops.filter_not_null(t, IsNotNull("s"))
    with pytest.raises(InvalidInput):
        ops.exchange(t, 0)


def test_lists_behind_a_flag(spark):
    t = table(spark, ("l", "list<int32>"), rows=[([1, None],)])
    assert error_class(ops.project, t, [("l", Column(0))]) == "unsupported_nested_family"
    assert ops.collect(ops.project(t, [("l", Column(0))], admission=Admission(lists=True))) == [([1, None],)]


def test_ansi_is_required(spark):
    t = table(spark, ("a", "int32"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(InvalidInput):
            ops.project(t, [("a", Column(0))])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_arrow_types_are_told_apart(spark):
    utc = dt.timezone.utc  # noqa: UP017
    data = pa.table({
        "u64": pa.array([2**64 - 1, None], pa.uint64()), "u32": pa.array([1, 2], pa.uint32()), "us": pa.array([dt.datetime(2020, 1, 1, tzinfo=utc), None], pa.timestamp("us", "UTC")),
        "ms": pa.array([0, 1], pa.timestamp("ms", "UTC")), "naive": pa.array([0, 1], pa.timestamp("us")), "f32": pa.array([1.0, 2.0], pa.float32()),
        "d256": pa.array([Decimal("1.0000"), None], pa.decimal256(40, 4)), "d": pa.array([Decimal("1.00"), None], pa.decimal128(10, 2)),
        "u": pa.UnionArray.from_dense(pa.array([0, 1], pa.int8()), pa.array([0, 0], pa.int32()), [pa.array([7], pa.int32()), pa.array([None], pa.int32())], ["i", "n"]),
    })
    t = from_arrow(spark, data)
    at = {f.name: i for i, f in enumerate(t.schema.fields)}
    good = ops.project(t, [(n, Column(at[n])) for n in ("u64", "us", "d", "u")])
    rows = ops.collect(good)
    assert rows[0][0] == Decimal(2**64 - 1) and rows[0][3].tag == "i" and rows[1][3].asDict() == {"tag": "n", "i": None, "n": None}
    assert good.schema.fields[3].token == UNION
    for name, want in (("u32", "unsupported_unsigned_family"), ("ms", "unsupported_temporal_unit"), ("naive", "unsupported_temporal_type"), ("f32", "unsupported_floating_type"), ("d256", "unsupported_decimal_type")):
        assert error_class(ops.project, t, [(name, Column(at[name]))]) == want


def test_parquet_round_trip_keeps_tokens(spark, tmp_path):
    t = table(spark, ("u", "uint64"), ("j", "json"), ("m", MAP), rows=[(Decimal(5), '{"a":1}', {1: None}), (None, None, None)])
    write_parquet(t, str(tmp_path / "t"))
    back = read_parquet(spark, str(tmp_path / "t"))
    assert [f.token for f in back.schema.fields] == ["uint64", "json", MAP] and sorted(map(str, ops.collect(back))) == sorted(map(str, ops.collect(t)))
    assert read_parquet(spark, str(tmp_path / "t"), {"u": "uint32"}, ["u"]).schema.fields[0].token == "uint32"


def test_batches_stay_in_order_and_empty_sources_have_a_schema(spark):
    schema = Schema.of(("a", "int32", False))
    t = from_rows(spark, schema, [(1,), (2,)], [], [(3,)])
    assert ops.collect(ops.exchange(t, 1, strict=True)) == ops.collect(t) == [(1,), (2,), (3,)]
    empty = from_rows(spark, schema)
    assert ops.collect(empty) == [] and empty.to_df().schema == T.StructType([T.StructField("a", T.IntegerType(), False)])


def test_pipeline_pushes_down(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 2, "x")], "a int, b int, c string").write.parquet(str(tmp_path / "p"))
    run = Pipeline("p", [lambda t: ops.filter_not_null(t, 0), lambda t: ops.project(t, [("s", Add(Column(0), Column(1)))])]).run(read_parquet(spark, str(tmp_path / "p")))
    run.to_df().explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(a)]" in plan and "ReadSchema: struct<a:int,b:int>" in plan and "Exchange" not in plan
    assert Table.of(run.to_df()).schema.fields[0].token == "int32"
