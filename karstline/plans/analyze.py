"""From expressions over a declared schema to Spark columns, or a typed error.

Every output's type is settled before Spark sees the plan, so index, type and
overload errors come before any error in the data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from karstline.errors import InvalidInput, JsonError, MissingColumn, OverloadError, UnsupportedType
from karstline.functions import add, collation
from karstline.functions.json import json_eq
from karstline.plans import expr as E
from karstline.plans.types import DEFAULT_ADMISSION, Admission, Field, Schema

LITERALS = ("int32", "uint64")


class Analyzer:
    def __init__(self, schema: Schema, names: list[str], admission: Admission = DEFAULT_ADMISSION):
        self.schema, self.names, self.admission = schema, names, admission

    def field(self, column: E.Column) -> Field:
        if not 0 <= column.index < len(self.schema):
            raise MissingColumn(f"column {column.index} of {len(self.schema)}")
        return self.schema.fields[column.index]

    def spark(self, column: E.Column) -> SparkColumn:
        return F.col(f"`{self.names[column.index]}`")

    def output(self, name: str, expression) -> tuple[SparkColumn, Field]:
        """A named output; the type of a bare column must be admitted to projections."""
        if isinstance(expression, E.Column):
            field = self.field(expression)
            self.admission.check_project(field)
            return self.spark(expression), field.renamed(name)
        column, field = self.value(expression)
        if field is None:
            raise OverloadError("an untyped NULL has no type of its own")
        return column, field.renamed(name)

    def value(self, expression) -> tuple[SparkColumn, Field | None]:
        if isinstance(expression, E.Column):
            return self.spark(expression), self.field(expression)
        if isinstance(expression, E.Literal):
            return self.literal(expression)
        if isinstance(expression, E.Add):
            return self.sum(expression)
        if isinstance(expression, E.Compare):
            return self.comparison(expression)
        if isinstance(expression, E.Cast):
            return self.cast(expression)
        raise InvalidInput(f"no such expression: {expression!r}")

    def literal(self, literal: E.Literal) -> tuple[SparkColumn, Field | None]:
        if literal.token is None:
            return F.lit(None), None
        if literal.token not in LITERALS:
            raise UnsupportedType(f"no literal of {literal.token}")
        low, high = (0, add.UINT64_MAX) if literal.token == "uint64" else (-(2**31), 2**31 - 1)
        if literal.value is not None and not low <= literal.value <= high:
            raise InvalidInput(f"{literal.value} is no {literal.token}")
        field = Field("literal", literal.token, literal.value is None)
        value = Decimal(literal.value) if literal.token == "uint64" and literal.value is not None else literal.value
        return F.lit(value).cast(field.spark_type), field

    def sum(self, node: E.Add) -> tuple[SparkColumn, Field]:
        (a, left), (b, right) = self.value(node.left), self.value(node.right)
        found = add.require(node.overload, left, right) if node.overload else add.resolve(left, right)
        nullable = any(f is None or f.nullable for f in (left, right))
        field = Field("sum", found.token, nullable)
        a, b = (x.cast(f.spark_type) if g is None else x for x, g, f in ((a, left, right), (b, right, left)))
        return found.lower(a, b), field

    def comparison(self, node: E.Compare) -> tuple[SparkColumn, Field]:
        if node.collation is not None:
            ref = collation.Collation.parse(node.collation)
            column, field = self.value(node.left)
            collation.check_input(field, "comparison")
            return collation.compare(node.op, column, F.lit(node.right), ref), Field("comparison", "boolean", field.nullable)
        (a, left), (b, right) = self.value(node.left), self.value(node.right)
        if "json" in (left.token, right.token):
            if node.op != "eq" or left.token != right.token:
                raise JsonError("JSON values have no order and equal only JSON values")
            return json_eq(a, b), Field("comparison", "boolean", left.nullable or right.nullable)
        raise UnsupportedType(f"no comparison of {left.token} and {right.token}", "unsupported_comparison")

    def cast(self, node: E.Cast):
        _, field = self.value(node.operand)
        if "json" in (field.token, node.token):
            raise JsonError(f"no cast from {field.token} to {node.token}", "unsupported_json_cast")
        raise UnsupportedType(f"no cast from {field.token} to {node.token}", "unsupported_cast")

    def predicate(self, node: E.IsNotNull) -> SparkColumn:
        if not isinstance(node.column, E.Column):
            raise InvalidInput("is_not_null takes a column")
        self.admission.check_filter(self.field(node.column))
        return self.spark(node.column).isNotNull()
