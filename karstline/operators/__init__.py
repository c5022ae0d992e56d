"""Operators from table to table: project, filter, exchange, order; collect ends a pipeline."""

from karstline.operators.core import collect, exchange, filter_not_null, order_by_collation, order_by_float64, order_by_timestamp, project

__all__ = ["collect", "exchange", "filter_not_null", "order_by_collation", "order_by_float64", "order_by_timestamp", "project"]
