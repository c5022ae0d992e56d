"""A DataFrame with its declared schema, and pipelines of operators over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstline.plans.types import Schema


@dataclass(frozen=True)
class Table:
    """Columns by position under unique internal names; the names that show are the schema's."""

    frame: DataFrame
    schema: Schema

    @staticmethod
    def of(frame: DataFrame, schema: Schema | None = None) -> Table:
        """A table over a DataFrame; its own schema by default, else the declared one, column by column."""
        schema = Schema.from_spark(frame.schema) if schema is None else schema
        return Table(frame.toDF(*[f"c{i}" for i in range(len(schema))]), schema)

    @property
    def names(self) -> list[str]:
        return self.frame.columns

    def to_df(self) -> DataFrame:
        """The DataFrame under its shown names, logical types in the metadata."""
        pairs = zip(self.names, self.schema.fields, strict=True)
        return self.frame.select(*[F.col(n).alias(f.name, metadata=f.metadata) for n, f in pairs])


@dataclass(frozen=True)
class Pipeline:
    """Operators in order, each from a table to a table."""

    name: str
    steps: Sequence[Callable[[Table], Table]]

    def run(self, source: Table) -> Table:
        for step in self.steps:
            source = step(source)
        return source
