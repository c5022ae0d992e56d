"""Outcomes in a form that engines can be compared in."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from karstline.functions.json import canonical
from karstline.plans.types import MAP, UNION, Field


@dataclass(frozen=True)
class Rows:
    fields: tuple[Field, ...]
    rows: tuple[tuple, ...]
    kind: str = "rows"

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass(frozen=True)
class Failure:
    error_class: str
    message: str = ""
    kind: str = "error"


Outcome = Rows | Failure


def float_token(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    return repr(float(x))


def float_rank(token: str | None) -> tuple:
    """Canonical order of float tokens, nulls first."""
    if token is None:
        return (0, 0.0, 0)
    if token == "NaN":
        return (2, 0.0, 0)
    x = float(token)
    return (1, x, 0 if token.startswith("-") else 1)


def carrier(field: Field, value):
    """A value as compared: decimals and uint64 as text, dates as days, instants as microseconds."""
    if value is None:
        return None
    token = field.token
    if token == "float64":
        return float_token(value)
    if token == "uint64":
        return str(int(value))
    if field.decimal:
        return f"{value:.{field.decimal[1]}f}"
    if token == "date32":
        return (value - dt.date(1970, 1, 1)).days
    if token.startswith("timestamp_tz"):
        instant = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
        return (instant - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    if token == "json":
        return canonical(value)
    if token == MAP:
        return [{"key": k, "value": v} for k, v in value.items()]
    if token == UNION:
        return {"tag": value["tag"], "value": value[value["tag"]]}
    if token.startswith("struct"):
        return value.asDict() if hasattr(value, "asDict") else dict(value)
    return value


def compare(case_id: str, left: Outcome, right: Outcome, names: tuple[str, str], mode: str = "row-order-preserved") -> dict:
    """One comparison: status, what was compared, and a line that says how it went."""
    a, b = names
    if "adapter_unavailable" in (getattr(left, "error_class", ""), getattr(right, "error_class", "")):
        return {"case_id": case_id, "status": "unsupported", "comparison_dimensions": [], "summary": f"{a} or {b} can't run `{case_id}`."}
    if left.kind != right.kind or isinstance(left, Failure):
        same = isinstance(left, Failure) and isinstance(right, Failure) and left.error_class == right.error_class
        told = [f"`{x.error_class}`" if isinstance(x, Failure) else f"{x.row_count} row(s)" for x in (left, right)]
        return {"case_id": case_id, "status": "match" if same else "drift", "comparison_dimensions": ["error_class"], "summary": f"{a} gave {told[0]}, {b} gave {told[1]}."}
    order = (lambda rows: sorted(rows, key=lambda r: float_rank(r[0]))) if mode == "float64-multiset-canonical" else list
    checks = {
        "field_name": [f.name for f in left.fields] == [f.name for f in right.fields],
        "field_nullability": [f.nullable for f in left.fields] == [f.nullable for f in right.fields],
        "logical_type": [f.token for f in left.fields] == [f.token for f in right.fields],
        "row_count": left.row_count == right.row_count,
        "row_values": order(left.rows) == order(right.rows),
    }
    unlike = [k for k, ok in checks.items() if not ok]
    summary = f"both gave {left.row_count} row(s)" if not unlike else f"{a} and {b} differ in {', '.join(unlike)}"
    return {"case_id": case_id, "status": "drift" if unlike else "match", "comparison_dimensions": list(checks) if not unlike else unlike, "summary": f"{summary}."}


def as_json(case_id: str, outcome: Outcome) -> dict:
    if isinstance(outcome, Failure):
        return {"case_id": case_id, "outcome": {"kind": "error", "error_class": outcome.error_class, "message": outcome.message[:300]}}
    fields = [{"name": f.name, "logical_type": f.token, "nullable": f.nullable} for f in outcome.fields]
    return {"case_id": case_id, "outcome": {"kind": "rows", "schema": fields, "rows": [list(r) for r in outcome.rows], "row_count": outcome.row_count}}
