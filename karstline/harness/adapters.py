"""Engines that run cases: the library on Spark, and SQL on DuckDB."""

from __future__ import annotations

import math
import re
from dataclasses import replace

from pyspark.sql import SparkSession

from karstline import operators as ops
from karstline.errors import classify
from karstline.harness.cases import INPUTS, SLICE_ADMISSION, Case
from karstline.harness.outcomes import Failure, Outcome, Rows, carrier
from karstline.plans import expr as E
from karstline.plans.table import Table
from karstline.plans.types import DEFAULT_ADMISSION, Field, Schema
from karstline.sources import from_rows

_ADD = re.compile(r"add-(int64|uint64|float64)-column-(\d+)-column-(\d+)")


class SparkAdapter:
    """``exchange``: every operator's result passes a strict exchange, for parity runs."""

    name = "spark"

    def __init__(self, spark: SparkSession, exchange: bool = False):
        self.spark, self.with_exchange = spark, exchange

    def execute(self, case: Case) -> Outcome:
        try:
            table = self.run(self.source(case), case)
            if self.with_exchange:
                table = ops.exchange(table, 2, strict=True)
            rows = ops.collect(table)
        except Exception as error:  # noqa: BLE001  any engine error is an outcome
            return Failure(classify(error), str(error))
        return Rows(table.schema.fields, tuple(tuple(carrier(f, v) for f, v in zip(table.schema.fields, r, strict=True)) for r in rows))

    def source(self, case: Case) -> Table:
        schema, rows = INPUTS[case.input_ref]
        if rows is not None:
            return from_rows(self.spark, schema, rows)
        # declared only: its analysis fails before any row is read
        stand_in = Schema(tuple(replace(f, token="int32") for f in schema.fields))
        return Table(from_rows(self.spark, stand_in).frame, schema)

    def run(self, table: Table, case: Case) -> Table:
        op, admission = case.operation, SLICE_ADMISSION.get(case.slice_id, DEFAULT_ADMISSION)
        if m := re.fullmatch(r"is-not-null-column-(\d+)", op):
            return ops.filter_not_null(table, int(m[1]), admission=admission)
        if op == "order-by-column-0-asc-nulls-last":
            return ops.order_by_timestamp(table, 0)
        if op == "order-by-column-0-asc":
            return ops.order_by_collation(table, 0, case.collation)
        return ops.project(table, [output(op, case.collation, table.schema)], strict=True, admission=admission)


def output(op: str, collation: str | None, schema: Schema) -> tuple[str, object]:
    """Name and expression of a projection reference."""
    if op == "column-a":
        return "a", E.Column(0)
    if m := re.fullmatch(r"column-(\d+)", op):
        i = int(m[1])
        return (schema.fields[i].name if i < len(schema) else op), E.Column(i)
    if m := _ADD.fullmatch(op):
        return "sum", E.Add(E.Column(int(m[2])), E.Column(int(m[3])), m[1])
    if m := re.fullmatch(r"(eq|lt)-column-0-literal-(\w+)", op):
        return "comparison", E.Compare(m[1], E.Column(0), m[2], collation)
    return {
        "literal-int32-seven": ("lit", E.int32(7)),
        "literal-int32-null": ("lit", E.int32(None)),
        "literal-uint64-7": ("lit", E.uint64(7)),
        "add-a-plus-one": ("a_plus_one", E.Add(E.Column(0), E.int32(1), "int32")),
        "less-than-column-0-column-0": ("comparison", E.Compare("lt", E.Column(0), E.Column(0))),
        "json-column-0-to-int32": ("cast", E.Cast(E.Column(0), "int32")),
        "utf8-column-0-to-json": ("cast", E.Cast(E.Column(0), "json")),
    }[op]


class DuckAdapter:
    """Plain SQL for the slices that DuckDB's types can express; others are unavailable."""

    name = "duckdb"
    TYPES = {"int32": "INTEGER", "int64": "BIGINT", "uint64": "UBIGINT", "utf8": "VARCHAR", "float64": "DOUBLE", "date32": "DATE", "timestamp_tz(us)": "TIMESTAMPTZ"}  # noqa: RUF012

    def __init__(self):
        import duckdb

        self.connection = duckdb.connect()
        self.connection.execute("SET TimeZone = 'UTC'")

    def _type(self, field: Field) -> str | None:
        return f"DECIMAL({field.decimal[0]},{field.decimal[1]})" if field.decimal else self.TYPES.get(field.token)

    def execute(self, case: Case) -> Outcome:
        schema, rows = INPUTS[case.input_ref]
        kinds = [self._type(f) for f in schema.fields]
        plan = self.lower(case, schema)
        if rows is None or None in kinds or plan is None or case.collation not in (None, "binary"):
            return Failure("adapter_unavailable")
        if isinstance(plan, Failure):
            return plan
        sql, fields = plan
        literal = lambda v, k: "NULL" if v is None else f"CAST('{'NaN' if isinstance(v, float) and math.isnan(v) else v}' AS {k})"
        source = " UNION ALL ".join(f"SELECT {i} AS __row, " + ", ".join(f"{literal(v, k)} AS {f.name}" for v, k, f in zip(r, kinds, schema.fields, strict=True)) for i, r in enumerate(rows))
        try:
            found = self.connection.execute(f"WITH t AS ({source}) {sql}").fetchall()
        except Exception as error:  # noqa: BLE001
            text = str(error)
            overflow = "unsigned_overflow" if "UINT64" in text or "UBIGINT" in text else "arithmetic_overflow"
            return Failure(overflow if "Overflow" in text else "engine_error", text)
        return Rows(tuple(fields), tuple(tuple(carrier(f, v) for f, v in zip(fields, r, strict=True)) for r in found))

    def lower(self, case: Case, schema: Schema):
        op, names = case.operation, [f.name for f in schema.fields]
        if m := re.fullmatch(r"is-not-null-column-(\d+)", op):
            if int(m[1]) >= len(names):
                return Failure("missing_column")
            if case.slice_id == "first-filter-is-not-null-slice" and schema.fields[0].token != "int32":
                return None
            return f"SELECT {', '.join(names)} FROM t WHERE {names[int(m[1])]} IS NOT NULL ORDER BY __row", schema.fields
        if m := re.fullmatch(r"column-(\d+|a)", op):
            i = 0 if m[1] == "a" else int(m[1])
            return (f"SELECT {names[i]} FROM t ORDER BY __row", [schema.fields[i]]) if i < len(names) else Failure("missing_column")
        if op == "order-by-column-0-asc-nulls-last":
            return f"SELECT {names[0]} FROM t ORDER BY {names[0]} ASC NULLS LAST, __row", schema.fields
        if m := _ADD.fullmatch(op):
            tokens = {f.token for f in schema.fields}
            if m[1] == "uint64" and tokens != {"uint64"}:
                return None
            k = self.TYPES[m[1]]
            return f"SELECT CAST({names[0]} AS {k}) + CAST({names[1]} AS {k}) FROM t ORDER BY __row", [Field("sum", m[1], any(f.nullable for f in schema.fields))]
        if op == "add-a-plus-one":
            return f"SELECT {names[0]} + CAST(1 AS INTEGER) FROM t ORDER BY __row", [Field("a_plus_one", "int32", schema.fields[0].nullable)]
        if m := re.fullmatch(r"(eq|lt)-column-0-literal-(\w+)", op):
            if schema.fields[0].token != "utf8":
                return None
            return f"SELECT {names[0]} {'=' if m[1] == 'eq' else '<'} '{m[2]}' FROM t ORDER BY __row", [Field("comparison", "boolean", schema.fields[0].nullable)]
        if op.startswith("literal-int32"):
            return f"SELECT CAST({'NULL' if op.endswith('null') else 7} AS INTEGER) FROM t", [Field("lit", "int32", op.endswith("null"))]
        if op == "literal-uint64-7":
            return "SELECT CAST(7 AS UBIGINT) FROM t", [Field("lit", "uint64", False)]
        return None
