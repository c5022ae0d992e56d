"""One query for each operator and function over the Parquet tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline import operators as ops
from karstline.functions import floats
from karstline.functions.json import canonical_json
from karstline.harness.adapters import SparkAdapter
from karstline.harness.cases import CASES
from karstline.harness.outcomes import Failure
from karstline.plans.expr import Add, Column, Compare, int32, plus, uint64
from karstline.plans.table import Table
from karstline.plans.types import MAP, STRUCT, UNION, Schema
from karstline.sources import from_rows
from karstline.sources.ingest import declare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None, name: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str, columns: dict[str, str | SparkColumn], declared: dict[str, str] | None = None) -> Table:
    """A table of some columns, or of SQL expressions over them where the data have no such type."""
    frame = spark.read.parquet(f"{sf}/{name}.parquet")
    return declare(frame.select(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()]), declared)


# projections and literals
@_query("SELECT l_orderkey AS k, l_quantity AS q, l_orderkey AS k_again FROM lineitem")
def project_passthrough(spark, sf):
    t = _table(spark, sf, "lineitem", {"l_orderkey": "l_orderkey", "l_quantity": "l_quantity"})
    return ops.project(t, [("k", Column(0)), ("q", Column(1)), ("k_again", Column(0))]).to_df()


@_query("SELECT o_orderkey AS k, CAST(7 AS INTEGER) AS seven FROM orders")
def literal_int32(spark, sf):
    return ops.project(_table(spark, sf, "orders", {"k": "o_orderkey"}), [("k", Column(0)), ("seven", int32(7))]).to_df()


@_query("SELECT o_orderkey AS k, CAST(NULL AS INTEGER) AS nothing FROM orders")
def literal_int32_null(spark, sf):
    return ops.project(_table(spark, sf, "orders", {"k": "o_orderkey"}), [("k", Column(0)), ("nothing", int32(None))]).to_df()


@_query("SELECT o_orderkey AS k, CAST(18446744073709551615 AS DECIMAL(20,0)) AS most FROM orders")
def literal_uint64(spark, sf):
    return ops.project(_table(spark, sf, "orders", {"k": "o_orderkey"}), [("k", Column(0)), ("most", uint64(2**64 - 1))]).to_df()


# the add family
def _sum(spark, sf, columns: dict, left=0, right=1, declared=None, overload=None) -> DataFrame:
    t = _table(spark, sf, "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", **columns}, declared)
    n = len(t.schema) - len(columns)
    return ops.project(t, [("l_orderkey", Column(0)), ("l_linenumber", Column(1)), ("total", Add(Column(n + left), Column(n + right), overload))]).to_df()


def _add(name: str, columns: dict, sql: str, declared: dict | None = None, overload: str | None = None) -> None:
    _query(f"SELECT l_orderkey, l_linenumber, {sql} AS total FROM lineitem", name)(lambda spark, sf: _sum(spark, sf, columns, declared=declared, overload=overload))


@_query("SELECT l_orderkey, l_linenumber + 1 AS next FROM lineitem")
def add_int32_literal(spark, sf):
    t = _table(spark, sf, "lineitem", {"k": "l_orderkey", "n": "l_linenumber"})
    return ops.project(t, [("l_orderkey", Column(0)), ("next", Add(Column(1), int32(1), "int32"))]).to_df()


@_query("SELECT l_orderkey, (l_linenumber + 1) + l_linenumber AS total FROM lineitem")
def add_int32_nested(spark, sf):
    t = _table(spark, sf, "lineitem", {"k": "l_orderkey", "n": "l_linenumber"})
    return ops.project(t, [("l_orderkey", Column(0)), ("total", plus(plus(Column(1), int32(1)), Column(1)))]).to_df()


_U64 = {"a": "uint64", "b": "uint64"}
_add("add_int32_nulls", {"a": "nullif(l_linenumber, 1)", "b": "l_linenumber"}, "nullif(l_linenumber, 1) + l_linenumber", overload="int32")
_add("add_uint64", {"a": "cast(l_orderkey AS decimal(20,0))", "b": "cast(l_partkey AS decimal(20,0))"}, "CAST(CAST(l_orderkey AS UBIGINT) + CAST(l_partkey AS UBIGINT) AS DECIMAL(20,0))", _U64, "uint64")
_add("add_uint64_nulls", {"a": "cast(nullif(l_linenumber, 2) AS decimal(20,0))", "b": "cast(l_partkey AS decimal(20,0))"}, "CAST(CAST(nullif(l_linenumber, 2) AS UBIGINT) + CAST(l_partkey AS UBIGINT) AS DECIMAL(20,0))", _U64, "uint64")
_add("add_int64_exact", {"a": "l_orderkey", "b": "l_partkey"}, "l_orderkey + l_partkey")
_add("add_int32_int64", {"a": "l_linenumber", "b": "l_orderkey"}, "CAST(l_linenumber AS BIGINT) + l_orderkey", overload="int64")
_add("add_int64_int32", {"a": "l_orderkey", "b": "l_linenumber"}, "l_orderkey + CAST(l_linenumber AS BIGINT)", overload="int64")
_add("add_float64_exact", {"a": "l_extendedprice", "b": "l_tax"}, "l_extendedprice + l_tax")
_add("add_int32_float64", {"a": "l_linenumber", "b": "l_tax"}, "CAST(l_linenumber AS DOUBLE) + l_tax", overload="float64")
_add("add_float64_int32", {"a": "l_tax", "b": "l_linenumber"}, "l_tax + CAST(l_linenumber AS DOUBLE)", overload="float64")
_add("add_int64_float64", {"a": "l_orderkey", "b": "l_tax"}, "CAST(l_orderkey AS DOUBLE) + l_tax", overload="float64")
_add("add_float64_int64", {"a": "l_tax", "b": "l_orderkey"}, "l_tax + CAST(l_orderkey AS DOUBLE)", overload="float64")
_add("add_decimal_same_scale", {"a": "cast(l_extendedprice AS decimal(12,2))", "b": "cast(l_quantity AS decimal(12,2))"}, "CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_quantity AS DECIMAL(12,2))")
_add("add_decimal_mixed_scale", {"a": "cast(l_quantity AS decimal(10,2))", "b": "cast(l_tax AS decimal(8,4))"}, "CAST(CAST(l_quantity AS DECIMAL(10,2)) + CAST(l_tax AS DECIMAL(8,4)) AS DECIMAL(13,4))")


@_query("SELECT * FROM (VALUES (1, 'Infinity'), (2, 'NaN'), (3, 'NaN'), (4, '-0.0')) t(n, total)")
def add_float64_special(spark, sf):
    inf, nan = float("inf"), float("nan")
    t = from_rows(spark, Schema.of(("n", "int32", False), ("a", "float64"), ("b", "float64")), [(1, inf, 1.0), (2, -inf, inf), (3, nan, 2.0), (4, -0.0, -0.0)])
    found = ops.project(t, [("n", Column(0)), ("total", Add(Column(1), Column(2), "float64"))]).to_df()
    return found.select("n", F.col("total").cast("string").alias("total"))


# null filters, one for each admitted family
def _not_null(family: str, table: str, columns: dict, sql: str, declared: dict | None = None, shown: Callable | None = None) -> None:
    def run(spark, sf):
        kept = ops.filter_not_null(_table(spark, sf, table, columns, declared), 1).to_df()
        return shown(kept) if shown else kept

    _query(sql, f"not_null_{family}")(run)


_not_null("int32", "lineitem", {"k": "l_orderkey", "v": "nullif(l_linenumber, 1)"}, "SELECT l_orderkey AS k, l_linenumber AS v FROM lineitem WHERE l_linenumber != 1")
_not_null("uint64", "lineitem", {"k": "l_orderkey", "v": "cast(nullif(l_linenumber, 1) AS decimal(20,0))"}, "SELECT l_orderkey AS k, CAST(l_linenumber AS DECIMAL(20,0)) AS v FROM lineitem WHERE l_linenumber != 1", {"v": "uint64"})
_not_null("utf8", "customer", {"k": "c_custkey", "v": "nullif(c_mktsegment, 'BUILDING')"}, "SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_mktsegment != 'BUILDING'")
_not_null("date32", "orders", {"k": "o_orderkey", "v": "cast(if(o_orderkey % 3 = 0, NULL, o_orderdate) AS date)"}, "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS v FROM orders WHERE o_orderkey % 3 != 0")
_not_null("decimal128", "orders", {"k": "o_orderkey", "v": "cast(if(o_orderkey % 4 = 1, NULL, o_totalprice) AS decimal(14,2))"}, "SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(14,2)) AS v FROM orders WHERE o_orderkey % 4 != 1")
_not_null("float64", "orders", {"k": "o_orderkey", "v": "if(o_orderkey % 5 = 2, NULL, o_totalprice)"}, "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 != 2")
_not_null("timestamp_tz", "events", {"k": "event_id", "v": "cast(if(event_id % 3 = 1, NULL, ts) AS timestamp)"}, "SELECT event_id AS k, epoch_us(ts) AS v FROM events WHERE event_id % 3 != 1", shown=lambda d: d.select("k", F.unix_micros("v").alias("v")))
_not_null("json", "events", {"k": "event_id", "v": "if(event_id % 2 = 0, NULL, props)"}, "SELECT event_id AS k, props AS v FROM events WHERE event_id % 2 != 0", {"v": "json"})


# collations and orders
def _collated(op: str, ref: str, sql: str) -> None:
    def run(spark, sf):
        t = _table(spark, sf, "customer", {"k": "c_custkey", "s": "if(c_custkey % 2 = 0, lower(c_mktsegment), c_mktsegment)"})
        return ops.project(t, [("k", Column(0)), ("hit", Compare(op, Column(1), "MACHINERY", ref))]).to_df()

    _query(f"SELECT c_custkey AS k, {sql} AS hit FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer)", f"collation_{op}_{'ci' if ref == 'unicode_ci' else ref}")(run)


_collated("eq", "binary", "s = 'MACHINERY'")
_collated("eq", "unicode_ci", "lower(s) = 'machinery'")
_collated("lt", "binary", "s < 'MACHINERY'")
_collated("lt", "unicode_ci", "lower(s) < 'machinery'")

_NAMES = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END"


def _ordered_names(spark, sf, ref):
    t = _table(spark, sf, "customer", {"k": "c_custkey", "s": _NAMES})
    return ops.order_by_collation(t, 1, ref, rank="place").to_df()


@_query(f"SELECT c_custkey AS k, s, row_number() OVER (ORDER BY s NULLS FIRST, c_custkey) AS place FROM (SELECT c_custkey, {_NAMES} AS s FROM customer)")
def collation_order_binary(spark, sf):
    return _ordered_names(spark, sf, "binary")


@_query(f"SELECT c_custkey AS k, s, row_number() OVER (ORDER BY lower(s) NULLS FIRST, s NULLS FIRST, c_custkey) AS place FROM (SELECT c_custkey, {_NAMES} AS s FROM customer)")
def collation_order_ci(spark, sf):
    return _ordered_names(spark, sf, "unicode_ci")


@_query("SELECT event_id AS k, row_number() OVER (ORDER BY CASE WHEN event_id % 3 = 1 THEN NULL ELSE ts END NULLS LAST, event_id) AS place FROM events")
def timestamp_order_nulls_last(spark, sf):
    t = _table(spark, sf, "events", {"k": "event_id", "ts": "cast(if(event_id % 3 = 1, NULL, ts) AS timestamp)"})
    return ops.order_by_timestamp(t, 1, rank="place").to_df().select("k", "place")


@_query("SELECT * FROM (VALUES (1, 1704067200000000), (2, 1704067200000000), (3, 1704067200000000)) t(n, us)")
def timestamp_equivalent_instants(spark, sf):
    texts = ("2024-01-01T00:00:00+00:00", "2023-12-31T19:00:00-05:00", "2024-01-01T09:00:00+09:00")
    frame = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "n int, t string").select("n", F.to_timestamp("t").alias("ts"))
    done = ops.project(declare(frame), [("n", Column(0)), ("ts", Column(1))]).to_df()
    return done.select("n", F.unix_micros("ts").alias("us"))


@_query("SELECT * FROM (VALUES ('NaN', 6), ('1.0', 4), ('-Infinity', 1), ('Infinity', 5), ('0.0', 3), ('-0.0', 2)) t(f, place)")
def float64_canonical_order(spark, sf):
    inf, nan = float("inf"), float("nan")
    t = from_rows(spark, Schema.of(("f", "float64")), [(x,) for x in (nan, 1.0, -inf, inf, 0.0, -0.0)])
    return ops.order_by_float64(t, 0, rank="place").to_df().select(F.col("f").cast("string").alias("f"), "place")


_SPECIAL = {1: "NULL", 2: "double('NaN')", 3: "double('Infinity')", 4: "double('-Infinity')", 5: "double('0.0')", 6: "double('-0.0')"}


@_query("""
SELECT kind, CASE WHEN kind = 0 THEN x END AS value,
  row_number() OVER (ORDER BY CASE kind WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 3 WHEN 2 THEN 4 ELSE 2 END, CASE WHEN kind = 0 THEN x ELSE 0 END, CASE kind WHEN 6 THEN 0 ELSE 1 END) AS place
FROM (SELECT CASE WHEN l_orderkey % 97 BETWEEN 1 AND 6 THEN l_orderkey % 97 ELSE 0 END AS kind, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS DOUBLE) AS x FROM lineitem)
""")
def float64_order_lineitem(spark, sf):
    """Canonical order over a whole table, special values among its own, as each row's place."""
    special = " ".join(f"WHEN {k} THEN {v}" for k, v in _SPECIAL.items())
    kind = "CASE WHEN l_orderkey % 97 BETWEEN 1 AND 6 THEN l_orderkey % 97 ELSE 0 END"
    t = _table(spark, sf, "lineitem", {"kind": f"cast({kind} AS bigint)", "x": f"CASE l_orderkey % 97 {special} ELSE cast(if(l_linenumber % 2 = 0, -l_extendedprice, l_extendedprice) AS double) END"})
    return ops.order_by_float64(t, 1, rank="place").to_df().select("kind", F.when(F.col("kind") == 0, F.col("x")).alias("value"), "place")


def _ieee(name: str, f: Callable, sql: str) -> None:
    odd = "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN NULL ELSE {} END"
    a, b = odd.format("l_tax"), "CASE WHEN l_orderkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END"

    def run(spark, sf):
        t = _table(spark, sf, "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "a": a, "b": b}).to_df()
        return t.select("k", "n", f(F.col("a"), F.col("b")).alias("hit"))

    _query(f"SELECT k, n, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE {sql} AND NOT isnan(a) AND NOT isnan(b) END AS hit FROM (SELECT l_orderkey AS k, l_linenumber AS n, {a} AS a, {b} AS b FROM lineitem)", name)(run)


_ieee("float64_ieee_eq", floats.ieee_eq, "a = b")
_ieee("float64_ieee_lt", floats.ieee_lt, "a < b")


# JSON and nested families
@_query("SELECT event_id AS k, '{\"a\":' || CAST(event_id % 5 AS VARCHAR) || ',' || substr(replace(props, ' ', ''), 2) AS canonical FROM events")
def json_canonical(spark, sf):
    t = _table(spark, sf, "events", {"k": "event_id", "j": "concat(rtrim('}', props), ', \"a\" : ', event_id % 5, '}')"}, {"j": "json"})
    return ops.project(t, [("k", Column(0)), ("j", Column(1))]).to_df().select("k", canonical_json(F.col("j")).alias("canonical"))


@_query("SELECT event_id AS k, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 4 != 2 END AS same FROM events")
def json_eq(spark, sf):
    a = "concat('{\"x\": 1, \"p\": ', props, '}')"
    b = "CASE event_id % 4 WHEN 0 THEN concat('{\"p\":', props, ',\"x\":1}') WHEN 1 THEN concat('{\"x\":1,\"p\":', props, '}') WHEN 2 THEN concat('{\"x\":2,\"p\":', props, '}') END"
    t = _table(spark, sf, "events", {"k": "event_id", "a": a, "b": b}, {"a": "json", "b": "json"})
    return ops.project(t, [("k", Column(0)), ("same", Compare("eq", Column(1), Column(2)))]).to_df()


@_query("SELECT event_id AS k, CASE WHEN event_id % 3 = 1 THEN 'null' ELSE props END AS j FROM events WHERE event_id % 3 != 0")
def json_null_vs_sql_null(spark, sf):
    t = _table(spark, sf, "events", {"k": "event_id", "j": "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE props END"}, {"j": "json"})
    return ops.filter_not_null(t, 1).to_df()


def _passed(spark, sf, expression: str, token: str) -> DataFrame:
    t = _table(spark, sf, "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "x": expression}, {"x": token})
    return ops.project(t, [("k", Column(0)), ("n", Column(1)), ("x", Column(2))]).to_df()


@_query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber != 3 THEN l_linenumber END AS a, CASE WHEN l_linenumber NOT IN (2, 3) THEN l_linenumber + 1 END AS b FROM lineitem")
def struct_passthrough(spark, sf):
    found = _passed(spark, sf, "if(l_linenumber = 3, NULL, named_struct('a', l_linenumber, 'b', if(l_linenumber = 2, NULL, l_linenumber + 1)))", STRUCT)
    return found.select("k", "n", "x.a", "x.b")


@_query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) || '=' || CASE WHEN l_linenumber = 2 THEN 'null' ELSE CAST(l_linenumber + 1 AS VARCHAR) END END AS entries FROM lineitem")
def map_passthrough(spark, sf):
    found = _passed(spark, sf, "if(l_linenumber = 3, NULL, map(l_linenumber, if(l_linenumber = 2, NULL, l_linenumber + 1)))", MAP)
    text = F.transform(F.map_entries("x"), lambda e: F.concat_ws("=", e["key"].cast("string"), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return found.select("k", "n", F.array_join(text, ";").alias("entries"))


@_query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'i' ELSE 'n' END AS tag, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS value FROM lineitem")
def union_passthrough(spark, sf):
    build = "named_struct('tag', if(l_linenumber % 2 = 0, 'i', 'n'), 'i', if(l_linenumber % 2 = 0, l_linenumber, NULL), 'n', if(l_linenumber % 2 = 0 OR l_linenumber = 3, NULL, l_linenumber))"
    return _passed(spark, sf, build, UNION).select("k", "n", "x.tag", F.coalesce("x.i", "x.n").alias("value"))


# pipelines
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, null filter, projection with a sum: pushed into the scan as far as it goes, no shuffle."""
    t = _table(spark, sf, "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity"})
    kept = ops.filter_not_null(t, 1)
    return ops.project(kept, [("l_orderkey", Column(0)), ("next_line", Add(Column(1), int32(1), "int32")), ("l_quantity", Column(2))]).to_df()


_query("SELECT l_orderkey, l_linenumber + 1 AS next_line, l_quantity FROM lineitem WHERE l_linenumber IS NOT NULL", "filter_project_pipeline")(flagship)


@_query("SELECT CAST(0 AS BIGINT) AS unlike")
def exchange_parity(spark, sf):
    """Rows that a strict exchange adds or loses."""
    t = _table(spark, sf, "orders", {"k": "o_orderkey", "d": "cast(o_orderdate AS date)"})
    plain = ops.filter_not_null(t, 1)
    handed = ops.filter_not_null(ops.exchange(t, 4, strict=True), 1)
    a, b = plain.to_df(), handed.to_df()
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("unlike"))


def _expected_cases() -> str:
    rows = []
    for c in CASES:
        failed = isinstance(c.expected, Failure)
        rows.append(f"('{c.slice_id}', '{c.case_id}', '{c.expected.kind}', {repr(c.expected.error_class) if failed else 'NULL'}, {'NULL' if failed else c.expected.row_count}, TRUE)")
    return f"SELECT slice_id, case_id, kind, error_class, CAST(row_count AS BIGINT) AS row_count, as_expected FROM (VALUES {', '.join(rows)}) t(slice_id, case_id, kind, error_class, row_count, as_expected)"


def matches(case, outcome) -> bool:
    """Whether an outcome is the case's: error class, or fields and rows."""
    if isinstance(case.expected, Failure):
        return isinstance(outcome, Failure) and outcome.error_class == case.expected.error_class
    from karstline.harness.outcomes import compare

    return compare(case.case_id, outcome, case.expected, ("found", "expected"), case.mode)["status"] == "match"


@_query(_expected_cases())
def conformance_cases(spark, sf):
    """Runs every case of the harness; the table has a row a case."""
    adapter, rows = SparkAdapter(spark), []
    for c in CASES:
        found = adapter.execute(c)
        failed = isinstance(found, Failure)
        rows.append((c.slice_id, c.case_id, found.kind, found.error_class if failed else None, None if failed else found.row_count, matches(c, found)))
    return spark.createDataFrame(rows, "slice_id string, case_id string, kind string, error_class string, row_count long, as_expected boolean")
