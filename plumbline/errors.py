"""Typed failures. Every error has a kind, its details, a context stack (outermost first) and a remedy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class WorkflowError(Exception):
    """Base of all failures; ``context`` holds ("fold", 3), ("stage", "scale") and the like."""

    kind = "workflow"

    def __init__(self, message: str, remediation: str = "", context: tuple = (), **details: object) -> None:
        super().__init__(message)
        self.message, self.remediation, self.details = message, remediation, details
        self.context: tuple[tuple[str, object], ...] = tuple(context)

    def within(self, what: str, which: object) -> WorkflowError:
        """This error with one more, outer, context entry."""
        self.context = ((what, which), *self.context)
        return self

    def __str__(self) -> str:
        where = " > ".join(f"{w} {v}" for w, v in self.context)
        return f"{where + ': ' if where else ''}{self.message}" + (f" ({self.remediation})" if self.remediation else "")


class DataError(WorkflowError):
    """Bad input values. ``reason`` is one of ``REASONS``."""

    kind = "data"
    REASONS = ("negative dimension", "ragged matrix", "length mismatch", "index out of bounds", "non-finite",
               "negative weight", "all-zero weights", "empty feature name", "duplicate feature name")

    def __init__(self, reason: str, message: str, remediation: str = "", **details: object) -> None:
        super().__init__(message, remediation, **details)
        self.reason = reason


class ShapeError(WorkflowError):
    kind = "shape"


class SchemaError(WorkflowError):
    kind = "schema"


class ValidationError(WorkflowError):
    kind = "validation"


class NumericalError(WorkflowError):
    kind = "numerical"


class ConvergenceError(WorkflowError):
    kind = "convergence"


class CompatibilityError(WorkflowError):
    kind = "compatibility"


class ArtifactError(WorkflowError):
    kind = "artifact"


class CancelledError(WorkflowError):
    kind = "cancelled"


@contextmanager
def context(what: str, which: object) -> Iterator[None]:
    """Add a context entry to any failure inside."""
    try:
        yield
    except WorkflowError as error:
        raise error.within(what, which) from error.__cause__
