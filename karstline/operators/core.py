"""The runtime operators as DataFrame transformations.

Projections and filters are narrow: no operator here but the orderings moves
rows between tasks, and Catalyst pushes column choice and null filters into
the scan.  Spark evaluates lazily, so an overflow in a column that nothing reads
or in a row that a later filter drops raises nothing; ``strict`` puts a
checkpoint behind a projection where it must raise.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karstline.errors import InvalidInput, MissingColumn, UnsupportedType
from karstline.functions import collation, floats
from karstline.plans import expr as E
from karstline.plans.analyze import Analyzer
from karstline.plans.table import Table
from karstline.plans.types import DEFAULT_ADMISSION, Admission, Field, Schema, require_names
from karstline.session import require_ansi


def _barrier(table: Table) -> Table:
    """All rows computed and written to the shared folder of ``spark.checkpoint.dir``, partitions and order kept."""
    spark = table.frame.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise InvalidInput("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="karstline-"))
    return Table(table.frame.checkpoint(eager=True), table.schema)


def project(table: Table, outputs: Sequence[tuple[str, object]], *, strict: bool = False, admission: Admission = DEFAULT_ADMISSION) -> Table:
    """One row out for each row in, outputs in list order; all types are checked first."""
    require_names(name for name, _ in outputs)
    require_ansi(table.frame.sparkSession)
    analyzer = Analyzer(table.schema, table.names, admission)
    found = [analyzer.output(name, expression) for name, expression in outputs]
    frame = table.frame.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(found)])
    out = Table(frame, Schema(tuple(f for _, f in found)))
    fallible = any(not isinstance(e, (E.Column, E.Literal)) for _, e in outputs)
    return _barrier(out) if strict and fallible else out


def filter_not_null(table: Table, column: int | E.IsNotNull, *, admission: Admission = DEFAULT_ADMISSION) -> Table:
    """Rows with a value in the column, all columns as they are (nullability too)."""
    node = column if isinstance(column, E.IsNotNull) else E.IsNotNull(E.Column(column))
    kept = Analyzer(table.schema, table.names, admission).predicate(node)
    return Table(table.frame.where(kept), table.schema)


def exchange(table: Table, capacity: int = 1, *, strict: bool = False) -> Table:
    """A hand-over between stages that keeps rows and order: the identity, or a checkpoint if ``strict``.

    ``capacity`` bounded the queue between a producer and a consumer; Spark pulls
    rows within a stage, so it only has to be positive here.
    """
    if capacity <= 0:
        raise InvalidInput("an exchange needs a capacity over 0")
    return _barrier(table) if strict else table


def _ordered(table: Table, keys: list, rank: str | None) -> Table:
    """Sorted by keys, ties in input order; with ``rank``, a last column with each row's place instead of a sort.

    A place over all rows needs all rows in one order: where only places are asked
    for, rows are sorted by range over all tasks, counted by partition, and
    numbered from each partition's first place on, so no task sees all rows.
    """
    stable = [*keys, F.col("__row")]
    frame = table.frame.withColumn("__row", F.monotonically_increasing_id())
    if rank is None:
        return Table(frame.orderBy(*stable).drop("__row"), table.schema)
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _barrier(Table(frame.repartitionByRange(parts, *stable).sortWithinPartitions(*stable).withColumn("__part", F.spark_partition_id()), table.schema)).frame
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    # a row for each partition
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).select("__part", "before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*stable)) + F.col("before")
    ranked = dealt.join(F.broadcast(before), "__part").withColumn("__place", place.cast("bigint"))
    names = [*table.names, f"c{len(table.schema)}"]
    fields = (*table.schema.fields, Field(rank, "int64", False))
    return Table(ranked.select(*table.names, F.col("__place").alias(names[-1])), Schema(fields))


def _key(table: Table, index: int):
    if not 0 <= index < len(table.schema):
        raise MissingColumn(f"column {index} of {len(table.schema)}")
    return F.col(table.names[index]), table.schema.fields[index]


def order_by_collation(table: Table, index: int, collation_ref: str, *, rank: str | None = None) -> Table:
    """Ascending by a utf8 column's collation key, nulls first, ties by bytes, then input order."""
    ref = collation.Collation.parse(collation_ref)
    column, field = _key(table, index)
    collation.check_input(field, "ordering")
    return _ordered(table, collation.order_keys(column, ref), rank)


def order_by_timestamp(table: Table, index: int, *, rank: str | None = None) -> Table:
    """Ascending by instant, nulls last."""
    column, field = _key(table, index)
    if field.token != "timestamp_tz(us)":
        raise UnsupportedType(f"no timestamp ordering of {field.token}", "unsupported_temporal_type")
    return _ordered(table, [column.asc_nulls_last()], rank)


def order_by_float64(table: Table, index: int, *, rank: str | None = None) -> Table:
    """Canonical order of doubles: -Infinity, finite with -0.0 before 0.0, Infinity, NaN; nulls first."""
    column, field = _key(table, index)
    if field.token != "float64":
        raise UnsupportedType(f"no float64 ordering of {field.token}", "unsupported_floating_type")
    return _ordered(table, floats.canonical_order(column), rank)


def collect(table: Table) -> list[tuple]:
    """All rows on the driver; for results of a size that the caller knows."""
    return [tuple(r) for r in table.frame.collect()]
