"""Static rows, Arrow tables and Parquet files as tables with logical types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from karstline.plans.table import Table
from karstline.plans.types import MAP, STRUCT, UNION, Schema, rejection


def from_rows(spark: SparkSession, schema: Schema, *batches: Sequence[tuple]) -> Table:
    """A static source: batches of rows in order, one partition each (none: an empty table)."""
    names = [f"c{i}" for i in range(len(schema))]
    kind = schema.to_spark(names)
    frames = [spark.createDataFrame(list(b), kind, verifySchema=True).coalesce(1) for b in batches if len(b)]
    if not frames:
        return Table(spark.createDataFrame([], kind), schema)
    frame = frames[0]
    for more in frames[1:]:
        frame = frame.unionAll(more)
    return Table(frame, schema)


def read_parquet(spark: SparkSession, path: str, declared: dict[str, str] | None = None, columns: Sequence[str] | None = None) -> Table:
    """A table over Parquet files.

    Parquet keeps no unsigned or JSON types in what Spark reads; ``declared`` gives
    columns their logical token (a ``uint64`` column arrives as decimal(20,0), a
    ``uint32`` one as bigint and is then rejected by the analysis).
    """
    frame = spark.read.parquet(path)
    frame = frame if columns is None else frame.select(*columns)
    return declare(frame, declared)


def declare(frame: DataFrame, declared: dict[str, str] | None = None) -> Table:
    """A table over any DataFrame, with logical tokens for some of its columns."""
    schema = Schema.from_spark(frame.schema)
    fields = tuple(replace(f, token=(declared or {}).get(f.name, f.token)) for f in schema.fields)
    return Table.of(frame, Schema(fields))


def write_parquet(table: Table, path: str, mode: str = "errorifexists") -> None:
    """The table as Parquet; logical tokens stay in the fields' metadata."""
    table.to_df().write.mode(mode).parquet(path)


def arrow_token(field: pa.Field) -> str:
    """The logical token of an Arrow field."""
    kind = field.type
    if kind == pa.string():
        return "json" if (field.metadata or {}).get(b"logical_type") == b"json" else "utf8"
    for name in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float64", "float32", "float16", "date32", "date64", "binary"):
        if kind == getattr(pa, name)():
            return name
    if kind == pa.bool_():
        return "boolean"
    if pa.types.is_timestamp(kind):
        return f"timestamp_tz({kind.unit})" if kind.tz else f"timestamp({kind.unit})"
    if pa.types.is_decimal128(kind):
        return f"decimal128({kind.precision},{kind.scale})"
    if pa.types.is_decimal256(kind):
        return f"decimal256({kind.precision},{kind.scale})"
    if kind == pa.struct([pa.field("a", pa.int32(), False), pa.field("b", pa.int32())]):
        return STRUCT
    if pa.types.is_map(kind) and kind.key_type == kind.item_type == pa.int32() and kind.item_field.nullable:
        return MAP
    if pa.types.is_union(kind) and kind.mode == "dense" and {kind.field(i).name for i in range(kind.num_fields)} == {"i", "n"}:
        return UNION
    if kind == pa.list_(pa.int32()):
        return "list<int32>"
    return str(kind)


def _carrier(column: pa.ChunkedArray, token: str) -> pa.ChunkedArray | pa.Array:
    """The column in a type that Spark reads; what has none is left out as nulls."""
    if token == "uint64":
        return column.cast(pa.decimal128(20, 0))
    if token == UNION:
        names = [column.type.field(i).name for i in range(column.type.num_fields)]
        rows = []
        for chunk in column.chunks:
            for code, value in zip(chunk.type_codes.to_pylist(), chunk.to_pylist(), strict=True):
                tag = names[chunk.type.type_codes.index(code)]
                rows.append({"tag": tag, "i": value if tag == "i" else None, "n": value if tag == "n" else None})
        return pa.array(rows, pa.struct([pa.field("tag", pa.string(), False), ("i", pa.int32()), ("n", pa.int32())]))
    return column


def from_arrow(spark: SparkSession, data: pa.Table) -> Table:
    """A table over Arrow data, types taken from the Arrow schema before Spark widens any.

    Columns of a type that Spark can't carry are kept as declared fields, so that
    using one is a typed error and not using it is none.
    """
    fields, arrays = [], []
    for field in data.schema:
        token = arrow_token(field)
        carried = rejection(token) in ("unsupported_type", "unsupported_nested_family") or token.startswith(("decimal128", "timestamp_tz(us", "float64", "float32"))
        array = _carrier(data.column(field.name), token) if carried else pa.nulls(len(data), pa.int32())
        fields.append((field.name, token, field.nullable))
        arrays.append(array)
    schema = Schema.of(*fields)
    return Table(spark.createDataFrame(pa.table(arrays, names=[f"c{i}" for i in range(len(fields))])), schema)
