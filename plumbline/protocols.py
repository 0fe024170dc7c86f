"""The interfaces that code outside the library can implement; nothing here has to be inherited from.

Data are DataFrames with named columns; see :mod:`plumbline.sources.dataset` for their roles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

from plumbline.plans.execution import Execution
from plumbline.plans.pipeline import Estimator, Transformer
from plumbline.schema import FeatureSchema

__all__ = ["Classifier", "Estimator", "Execution", "FittedTransformer", "Generator", "NumericalBackend", "Regressor", "Scorer",
           "Specification", "Splitter", "Transformer"]


@runtime_checkable
class Specification(Protocol):
    """Immutable options, equal by value, that a fitted object keeps as ``spec``."""

    def __eq__(self, other: object) -> bool: ...

    def __hash__(self) -> int: ...


@runtime_checkable
class FittedTransformer(Protocol):
    schema: FeatureSchema
    output_schema: FeatureSchema

    def transform(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, validate: bool = False) -> tuple[DataFrame, list[str]]: ...


@runtime_checkable
class Regressor(Protocol):
    """What a regression estimator's ``fit`` returns."""

    def predict(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, name: str = "prediction",
                validate: bool = False) -> DataFrame: ...


@runtime_checkable
class Classifier(Protocol):
    """What a classification estimator's ``fit`` returns."""

    classes: tuple[int, int]

    def predict(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, name: str = "prediction",
                validate: bool = False) -> DataFrame: ...

    def predict_proba(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, names: tuple[str, str] = ("p_low", "p_high"),
                      validate: bool = False) -> DataFrame: ...


@runtime_checkable
class Scorer(Protocol):
    """A named score of a frame with truth and, by ``needs``, pred (a "value" or a "label") or p (a
    "probability" of the label ``positive``); greater is better."""

    name: str
    needs: str
    positive: int | None

    def __call__(self, df: DataFrame, weight: str | None = None) -> float: ...


@runtime_checkable
class Splitter(Protocol):
    """(row_id, fold) of a dataset, or (row_id, fold, part) where a row trains several folds."""

    def assign(self, data: Any, seed: int = 0) -> DataFrame: ...


@runtime_checkable
class Generator(Protocol):
    """An immutable generator: a draw returns its value and the next generator."""

    def next_int64(self) -> tuple[int, Generator]: ...

    def next_float(self) -> tuple[float, Generator]: ...


@runtime_checkable
class NumericalBackend(Protocol):
    """The dense kernels that the solvers need."""

    def sum(self, values: Sequence[float]) -> float: ...

    def dot(self, a: Sequence[float], b: Sequence[float]) -> float: ...

    def solve(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]: ...


def conforms(backend: NumericalBackend, close: Callable[[float, float], bool] = lambda a, b: abs(a - b) <= 1e-12 * max(1.0, abs(b))) -> list[str]:
    """What a numerical backend gets wrong; empty if nothing."""
    wrong = []
    for values, expected in (([1e16, 1.0, -1e16], 1.0), ([], 0.0), ([0.1] * 10, 1.0)):
        if not close(backend.sum(values), expected):
            wrong.append(f"sum of {values}")
    if not close(backend.dot([1e8, 1.0, -1e8], [1e8, 1.0, 1e8]), 1.0):
        wrong.append("dot product")
    found, rank = backend.solve(np.array([[2.0, 0.0], [0.0, 4.0], [0.0, 0.0]]), np.array([2.0, 8.0, 0.0]))
    if rank != 2 or not all(map(close, found, (1.0, 2.0))):
        wrong.append("least squares")
    found, rank = backend.solve(np.array([[1.0, 2.0], [2.0, 4.0]]), np.array([1.0, 2.0]))
    if rank != 1 or not close(float(found @ np.array([1.0, 2.0])), 1.0):
        wrong.append("rank-deficient least squares")
    return wrong


class DefaultBackend:
    """The library's own kernels."""

    def sum(self, values: Sequence[float]) -> float:
        from plumbline.functions.numeric import compensated_sum
        return compensated_sum(values)

    def dot(self, a: Sequence[float], b: Sequence[float]) -> float:
        from plumbline.functions.numeric import dot
        return dot(a, b)

    def solve(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
        from plumbline.operators.linalg import pivoted_solve
        return pivoted_solve(a, b)
