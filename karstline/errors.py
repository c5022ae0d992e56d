"""Typed errors, each with the class under which outcomes are compared."""

from __future__ import annotations


class EngineError(Exception):
    """An error with a normalised class; only the class is compared, never the text."""

    error_class = "engine_error"

    def __init__(self, message: str, error_class: str | None = None):
        super().__init__(message)
        if error_class is not None:
            self.error_class = error_class


class MissingColumn(EngineError):
    error_class = "missing_column"


class UnsupportedType(EngineError):
    """A type that a surface doesn't admit; the class says which family."""

    error_class = "unsupported_type"


class OverloadError(EngineError):
    """No overload of a function takes these operands."""

    error_class = "unsupported_arithmetic_type"


class CollationError(EngineError):
    error_class = "unknown_collation"


class JsonError(EngineError):
    error_class = "unsupported_json_comparison"


class AdmissionDenied(EngineError):
    error_class = "memory_admission_denied"


class AllocationFailed(EngineError):
    """Memory that admission granted could not be had."""

    error_class = "memory_allocation_failed"


class OwnershipViolation(EngineError):
    error_class = "ownership_contract_violation"


class InvalidInput(EngineError):
    """An argument that no data could make right, such as an empty projection."""

    error_class = "invalid_input"


#: Text that a raised guard or a failed task carries, and the class it stands for.
RAISED = {"UNSIGNED_OVERFLOW": "unsigned_overflow", "UNABLE_TO_ACQUIRE_MEMORY": "memory_allocation_failed", "OutOfMemoryError": "memory_allocation_failed"}


def classify(error: BaseException) -> str:
    """The class of any error: our own, else by Spark's condition, else by its text."""
    if isinstance(error, EngineError):
        return error.error_class
    if isinstance(error, MemoryError):
        return AllocationFailed.error_class
    condition = None
    for name in ("getCondition", "getErrorClass"):
        try:
            condition = condition or getattr(error, name)()
        except Exception:  # noqa: BLE001  some Spark errors have no condition
            continue
    text = f"{condition or ''} {error}"
    for mark, error_class in RAISED.items():
        if mark in text:
            return error_class
    if "ARITHMETIC_OVERFLOW" in text:
        return "arithmetic_overflow"
    return "engine_error"
