"""Weighted least squares, ridge and binary logistic regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ConvergenceError, NumericalError, ValidationError
from plumbline.functions.numeric import is_finite, linear, sigmoid
from plumbline.operators.linalg import pivoted_solve, qr_r, sum_vectors, tsqr
from plumbline.schema import FeatureSchema

DIRECT, GRADIENT, STEP = "direct_solution", "gradient_tolerance", "step_tolerance"


@dataclass(frozen=True)
class SolverReport:
    """``objective`` is divided by max(largest weight, penalty). A solver that doesn't converge
    raises, so ``converged`` is always true."""

    iterations: int
    objective: float
    reason: str
    rank: int | None = None
    converged: bool = True


def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")


def _checked(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df``, after one job that looks for predictions that aren't finite."""
    if df.where(~is_finite(F.col(name))).take(1):
        raise NumericalError("a prediction is not finite", "check or rescale the features")
    return df


@dataclass(frozen=True)
class FittedLinear:
    """Coefficients of a linear model; predictions are one lazy projection."""

    spec: LinearRegression | RidgeRegression
    coefficients: tuple[float, ...]
    intercept: float
    schema: FeatureSchema
    report: SolverReport

    task = "regression"

    def prediction(self, inputs: Sequence[Column]) -> Column:
        out = F.lit(self.intercept)
        for x, c in zip(inputs, self.coefficients, strict=True):
            out = out + x * F.lit(c)
        return out

    def predict(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, name: str = "prediction",
                validate: bool = False) -> DataFrame:
        self.schema.require(schema, "prediction")
        out = df.withColumn(name, linear(columns, self.coefficients, self.intercept))
        return _checked(out, columns, name) if validate else out


def solve_factor(r: np.ndarray, alpha: float, scale: float, rows: int) -> tuple[np.ndarray, int, float]:
    """Coefficients, rank and scaled objective from the factor of the centred, weighted [X y]."""
    n = r.shape[1] - 1
    if alpha > 0:
        penalty = np.hstack([np.eye(n) * math.sqrt(alpha / scale), np.zeros((n, 1))])
        r, rows = qr_r(np.vstack([r, penalty])), rows + n
    beta, rank = pivoted_solve(r[:, :n], r[:, n], rows)
    residual = r[:, n] - r[:, :n] @ beta
    return beta, rank, 0.5 * float(residual @ residual)


def _fit(df: DataFrame, columns: Sequence[str], target: str, weight: str | None, alpha: float, intercept: bool):
    """One TSQR pass over [1, x, y], scaled by the roots of the weights. Its first row absorbs the intercept, which is
    weighted centring; values are taken from those of any one row, so that large or constant columns lose no digits."""
    columns = [F.col(f"`{c}`").cast("double") for c in [*columns, target]]
    any_row = df.select(*columns).head(1)
    if not any_row:
        raise ValidationError("no rows to fit on", "fit on a non-empty dataset")
    shift = np.array([v if intercept and v is not None and math.isfinite(v) else 0.0 for v in any_row[0]])
    root = F.sqrt(_w(weight))
    factor = tsqr(df, [root, *(root * (c - F.lit(float(m))) for c, m in zip(columns, shift, strict=True))])[0]
    if not np.isfinite(factor.r).all():
        raise NumericalError("the design is not finite", "impute and rescale the features and the target")
    top = factor.top ** 2
    if not top > 0:
        raise ValidationError("no row has a positive weight", "give at least one row a positive weight")
    scale = max(top, alpha)
    centred = factor.r[1:, 1:] if intercept else qr_r(factor.r[:, 1:])
    beta, rank, objective = solve_factor(centred / math.sqrt(scale), alpha, scale, factor.rows)
    b = 0.0
    if intercept:
        first = factor.r[0]
        b = float((first[-1] - first[1:-1] @ beta) / first[0] + shift[-1] - shift[:-1] @ beta)
    if not (math.isfinite(b) and math.isfinite(objective) and np.isfinite(beta).all()):
        raise NumericalError("the intercept or objective is not finite", "rescale the features and the target")
    return tuple(map(float, beta)), b, SolverReport(1, objective, DIRECT, rank)


@dataclass(frozen=True)
class LinearRegression:
    """Weighted least squares; the intercept is found by weighted centring. One TSQR pass; no normal
    equations."""

    fit_intercept: bool = True

    alpha = 0.0
    task = "regression"

    def fit(self, df, columns, target, schema, weight=None, seed=0) -> FittedLinear:
        return FittedLinear(self, *_fit_as(df, columns, target, schema, weight, 0.0, self.fit_intercept))


def _fit_as(df, columns, target, schema, weight, alpha, intercept):
    beta, b, report = _fit(df, columns, target, weight, alpha, intercept)
    return beta, b, schema, report


@dataclass(frozen=True)
class RidgeRegression:
    """Least squares plus alpha/2 of the squared coefficients; the intercept is free. The penalty
    joins the factor as rows, so any number of alphas shares one pass (see plans.fusion)."""

    alpha: float = 1.0
    fit_intercept: bool = True

    task = "regression"

    def __post_init__(self) -> None:
        if not (math.isfinite(self.alpha) and self.alpha >= 0):
            raise ValidationError("alpha is negative or not finite", "use a finite alpha of 0 or more")

    def fit(self, df, columns, target, schema, weight=None, seed=0) -> FittedLinear:
        return FittedLinear(self, *_fit_as(df, columns, target, schema, weight, self.alpha, self.fit_intercept))


def discover_classes(df: DataFrame, target: str, weight: str | None = None) -> tuple[int, int]:
    """The two classes of positive weight, ascending; any other number of classes is an error. At most three
    labels reach the driver."""
    labels = df.where(_w(weight) > 0).select(F.col(f"`{target}`").cast("long")).distinct().limit(3).collect()
    if len(labels) != 2:
        raise ValidationError(f"{len(labels)} classes have positive weight", "fit on exactly two classes")
    low, high = sorted(r[0] for r in labels)
    return low, high


def _curvature(block: np.ndarray, theta: np.ndarray, n: int, m: int, whole: bool = True) -> np.ndarray:
    """Loss and, if ``whole``, gradient and Hessian of rows (x.., weight, target), flat."""
    x, v, y = block[:, :n], block[:, n], block[:, n + 1]
    if m > n:
        x = np.hstack([x, np.ones((len(x), 1))])
    z = x @ theta
    loss = float(v @ (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z))
    if not whole:
        return np.array([loss])
    e = np.exp(-np.abs(z))
    p = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
    return np.r_[loss, x.T @ (v * (p - y)), (x.T @ (x * (v * p * (1 - p))[:, None])).ravel()]


@dataclass(frozen=True)
class FittedLogistic:
    spec: LogisticRegression
    coefficients: tuple[float, ...]
    intercept: float
    classes: tuple[int, int]
    schema: FeatureSchema
    report: SolverReport

    task = "classification"

    def decision(self, inputs: Sequence[Column]) -> Column:
        out = F.lit(self.intercept)
        for x, c in zip(inputs, self.coefficients, strict=True):
            out = out + x * F.lit(c)
        return out

    def _z(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema) -> Column:
        self.schema.require(schema, "prediction")
        return linear(columns, self.coefficients, self.intercept)

    def decision_function(self, df, columns, schema, name="decision", validate=False) -> DataFrame:
        out = df.withColumn(name, self._z(df, columns, schema))
        return _checked(out, columns, name) if validate else out

    def predict_proba(self, df, columns, schema, names=("p_low", "p_high"), validate=False) -> DataFrame:
        """Probabilities of the lower and higher class."""
        p = sigmoid(self._z(df, columns, schema))
        out = df.withColumns({names[0]: 1 - p, names[1]: p})
        return _checked(out, columns, names[1]) if validate else out

    def predict(self, df, columns, schema, name="prediction", validate=False) -> DataFrame:
        """The higher class where the decision is above zero; a tie gives the lower."""
        z = self._z(df, columns, schema)
        if validate:
            _checked(df.select(z.alias("z")), columns, "z")
        return df.withColumn(name, F.when(z > 0, self.classes[1]).otherwise(self.classes[0]))


@dataclass(frozen=True)
class LogisticRegression:
    """Binary logistic loss plus squared coefficients / (2C); the intercept is free.

    Damped Newton: a round is one pass that sums objective, gradient and Hessian in numpy blocks, and
    one more only if the whole step doesn't improve enough; the small system is solved on the driver. Classes are those of positive
    weight, in ascending order.
    """

    c: float = 1.0
    fit_intercept: bool = True
    tolerance: float = 1e-8
    max_iterations: int = 100

    task = "classification"

    def __post_init__(self) -> None:
        if not (math.isfinite(self.c) and self.c > 0):
            raise ValidationError("C is not positive", "use a finite C above 0")
        if not (math.isfinite(self.tolerance) and self.tolerance > 0):
            raise ValidationError("the tolerance is not positive", "use a finite tolerance above 0")
        if self.max_iterations < 1:
            raise ValidationError("no iterations are allowed", "allow at least one")

    def fit(self, df, columns, target, schema, weight=None, seed=0) -> FittedLogistic:
        columns, w = list(columns), _w(weight)
        used = df.where(w > 0)
        labels = discover_classes(df, target, weight)
        top = float(used.agg(F.max(w)).first()[0]) if weight else 1.0
        penalty = 1.0 / self.c
        scale = max(top, penalty)
        ridge = penalty / scale
        n, m = len(columns), len(columns) + self.fit_intercept
        prepared = used.select(
            *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
            (w / F.lit(scale)).alias("v"), F.when(F.col(f"`{target}`") == labels[1], 1.0).otherwise(0.0).alias("y")).persist()
        try:
            return self._solve(prepared, n, m, ridge, labels, schema)
        finally:
            prepared.unpersist()

    def _solve(self, prepared, n, m, ridge, labels, schema) -> FittedLogistic:
        def penalized(theta: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            beta = np.r_[theta[:n], np.zeros(m - n)]
            hessian = sums[1 + m:].reshape(m, m).copy()
            hessian[np.arange(n), np.arange(n)] += ridge
            return float(sums[0]) + 0.5 * ridge * float(beta @ beta), sums[1:1 + m] + ridge * beta, hessian

        def full(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            return penalized(theta, sum_vectors(prepared, 1 + m + m * m, lambda block: _curvature(block, theta, n, m)))

        theta = np.zeros(m)
        objective, gradient, hessian = full(theta)
        for done in range(self.max_iterations + 1):
            if not (math.isfinite(objective) and np.isfinite(gradient).all()):
                raise NumericalError("the objective or gradient is not finite", "rescale the features or lower C")
            if np.abs(gradient).max(initial=0.0) <= self.tolerance:
                return self._fitted(theta, n, labels, schema, SolverReport(done, objective, GRADIENT))
            if done == self.max_iterations:
                break
            direction, rank = pivoted_solve(hessian, gradient)
            if rank < m:
                raise NumericalError("the Hessian is rank deficient", "remove redundant features or lower C")
            slope = float(gradient @ direction)
            # the whole step's own gradient and Hessian come with its objective: usually the only pass
            step, found = 1.0, full(theta - direction)
            if not self._enough(found[0], objective, step, slope):
                step = self._shorter(prepared, theta, direction, objective, slope, n, m, ridge)
                found = full(theta - step * direction)
            moved, size = step * np.abs(direction).max(), np.abs(theta).max(initial=0.0)
            theta = theta - step * direction
            objective, gradient, hessian = found
            if moved <= self.tolerance * (1 + size):
                return self._fitted(theta, n, labels, schema, SolverReport(done + 1, objective, STEP))
        raise ConvergenceError(f"no convergence after {self.max_iterations} iterations",
                               "raise max_iterations, rescale the features or lower C")

    @staticmethod
    def _enough(value: float, objective: float, step: float, slope: float) -> bool:
        return math.isfinite(value) and value <= objective - 1e-4 * step * slope

    def _shorter(self, prepared, theta, direction, objective, slope, n, m, ridge) -> float:
        """The first halved step, of 29, that improves enough: one pass tries all of them."""
        steps = [0.5 ** i for i in range(1, 30)]
        thetas = [theta - s * direction for s in steps]
        sums = sum_vectors(prepared, len(steps), lambda block: np.array([_curvature(block, t, n, m, False)[0] for t in thetas]))
        for s, t, value in zip(steps, thetas, sums, strict=True):
            if self._enough(float(value) + 0.5 * ridge * float(t[:n] @ t[:n]), objective, s, slope):
                return s
        raise ConvergenceError("the line search made no progress", "rescale the features or lower C")

    def _fitted(self, theta, n, labels, schema, report) -> FittedLogistic:
        return FittedLogistic(self, tuple(map(float, theta[:n])), float(theta[n]) if self.fit_intercept else 0.0,
                              (labels[0], labels[1]), schema, report)
