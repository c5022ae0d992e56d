"""Expressions, logical types and their analysis into Spark columns."""
