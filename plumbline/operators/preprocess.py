"""Imputation, standardization and variance filtering: one aggregate to fit, one projection to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import DataError, NumericalError, ValidationError
from plumbline.functions.numeric import is_infinite, present
from plumbline.schema import FeatureSchema


def _no_weights(weight: object, what: str) -> None:
    if weight is not None:
        raise ValidationError(f"{what} takes no sample weights", "pass weights to the estimator only")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _check_infinite(found: dict, columns: Sequence[str]) -> None:
    for k, c in enumerate(columns):
        if found[f"inf{k}"]:
            raise DataError("non-finite", f"feature {c!r} has an infinite value", feature=k).within("feature", k)


def check_finite_output(df: DataFrame, columns: Sequence[str], operation: str) -> None:
    """One job: fail if any output is infinite or NaN."""
    bad = df.agg(*[F.count_if(F.isnan(_q(c)) | is_infinite(_q(c))).alias(f"b{k}") for k, c in enumerate(columns)]).first()
    for k, n in enumerate(bad):
        if n:
            raise NumericalError(f"{operation} made {n} values that are not finite", "rescale the features").within("feature", k)


@dataclass(frozen=True)
class SimpleImputer:
    """Replace NaN by the training mean, exact median or a constant."""

    strategy: str = "mean"
    value: float = 0.0

    def __post_init__(self) -> None:
        if self.strategy not in ("mean", "median", "constant"):
            raise ValidationError(f"unknown imputer strategy {self.strategy!r}", "use mean, median or constant")
        if self.strategy == "constant" and not math.isfinite(self.value):
            raise ValidationError("the imputer's constant is not finite", "choose a finite constant")

    def statistics(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """One row s0, s1, ... with inf0, ...: the training statistics; lazy but for medians."""
        if self.strategy == "median" and columns:
            made = [F.lit(v).cast(t).alias(f"{name}{k}") for k, (value, infinite) in enumerate(exact_medians(df, columns))
                    for name, v, t in (("s", value, "double"), ("inf", infinite, "boolean"))]
            return df.sparkSession.range(1).select(*made)
        out = []
        for k, c in enumerate(columns):
            x = present(_q(c))
            finite = F.when(~is_infinite(x), x)
            if self.strategy == "mean":
                # scaled by a power of two near the largest value, so sums of huge values don't overflow
                out.append(F.avg(finite * F.lit(2.0 ** -64)).alias(f"m{k}"))
                s = F.avg(finite)
            else:
                s = F.lit(float(self.value))
            out += [s.alias(f"s{k}"), F.coalesce(F.max(is_infinite(x)), F.lit(False)).alias(f"inf{k}")]
        return df.agg(*out) if out else df.agg(F.count(F.lit(1)).alias("rows"))

    def fit(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, weight: str | None = None, seed: int = 0):
        _no_weights(weight, "an imputer")
        if self.strategy == "median" and columns:
            found = {f"{name}{k}": v for k, (value, infinite) in enumerate(exact_medians(df, columns))
                     for name, v in (("s", value), ("inf", infinite))}
        else:
            found = self.statistics(df, columns).first().asDict()
        _check_infinite(found, columns)
        values = []
        for k, c in enumerate(columns):
            s = found[f"s{k}"]
            if s is None:
                raise ValidationError(f"feature {c!r} has no value to learn from", "drop it or impute a constant").within("feature", k)
            if not math.isfinite(s) and f"m{k}" in found:
                s = found[f"m{k}"] * 2.0 ** 64
            values.append(float(s))
        return FittedImputer(self, tuple(values), schema)


@dataclass(frozen=True)
class FittedImputer:
    spec: SimpleImputer
    values: tuple[float, ...]
    schema: FeatureSchema

    @property
    def output_schema(self) -> FeatureSchema:
        return self.schema

    def expressions(self, inputs: Sequence[Column]) -> list[Column]:
        return [F.when(F.isnan(x), F.lit(v)).otherwise(x) for x, v in zip(inputs, self.values, strict=True)]

    def transform(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, validate: bool = False) -> tuple[DataFrame, list[str]]:
        return _apply(self, df, columns, schema, "imputation", validate)


#: Rows of a bracket whose values the driver gets counted; a larger bracket is narrowed first.
MEDIAN_ROWS = 500_000
_ACCURACY = 1000


def exact_medians(df: DataFrame, columns: Sequence[str], most: int = MEDIAN_ROWS) -> list[tuple[float | None, bool]]:
    """(median of the finite values that are present, whether any is infinite) of every column.

    Nothing is sorted and no task holds a column: a column of more than ``most`` values is narrowed
    to a bracket around its middle, by a sketch and an exact count of what lies below and inside (a
    bracket that missed the middle is widened); then the values inside are counted one by one. Few
    values found often count as few rows. Each step is one pass for all columns.
    """
    p = range(len(columns))
    cells = df.select(*[present(_q(c)).alias(f"x{k}") for k, c in enumerate(columns)])
    low, high = [-math.inf for _ in p], [math.inf for _ in p]

    def inside(k: int, a: float, b: float) -> Column:
        x = F.col(f"x{k}")
        return F.when(~is_infinite(x) & (x >= a) & (x <= b), x)

    found = cells.agg(*[a for k in p for a in (
        F.count(inside(k, low[k], high[k])).alias(f"n{k}"),
        F.coalesce(F.max(is_infinite(F.col(f"x{k}"))), F.lit(False)).alias(f"inf{k}"))]).first().asDict()
    n, infinite = [found[f"n{k}"] for k in p], [found[f"inf{k}"] for k in p]
    below, rows, margin = [0 for _ in p], list(n), [0.01 for _ in p]
    while wide := [k for k in p if rows[k] > most and low[k] < high[k] and margin[k] < 1]:
        middle = {k: ((n[k] - 1) / 2 - below[k]) / rows[k] for k in wide}
        sketch = cells.agg(*[F.percentile_approx(
            inside(k, low[k], high[k]), [max(0.0, middle[k] - margin[k]), min(1.0, middle[k] + margin[k])], _ACCURACY) for k in wide]).first()
        tried = dict(zip(wide, sketch, strict=True))
        counts = cells.agg(*[a for k in wide for a in (
            F.count_if(~is_infinite(F.col(f"x{k}")) & (F.col(f"x{k}") < tried[k][0])),
            F.count(inside(k, *tried[k])))]).first()
        for i, k in enumerate(wide):
            under, within = counts[2 * i], counts[2 * i + 1]
            if under <= (n[k] - 1) // 2 and n[k] // 2 < under + within and within < rows[k]:
                (low[k], high[k]), below[k], rows[k] = tried[k], under, within
            else:
                margin[k] *= 4
    values = F.array(*[F.struct(F.lit(k).alias("k"), inside(k, low[k], high[k]).alias("v")) for k in p])
    counted = (cells.select(F.explode(values).alias("c")).select("c.k", "c.v").where("v is not null")
               .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).toArrow())
    ks, vs, ns = (counted.column(c).to_numpy() for c in ("k", "v", "n"))
    out: list[tuple[float | None, bool]] = []
    for k in p:
        order = np.argsort(vs[ks == k], kind="stable")
        v, reached = vs[ks == k][order], below[k] + np.cumsum(ns[ks == k][order])
        if not n[k]:
            out.append((None, infinite[k]))
            continue
        a, b = (float(v[np.searchsorted(reached, at, side="right")]) for at in ((n[k] - 1) // 2, n[k] // 2))
        out.append((a if a == b else a / 2 + b / 2, infinite[k]))
    return out


def _apply(fitted, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, what: str, validate: bool):
    fitted.schema.require(schema, what)
    columns = list(columns)
    made = fitted.expressions([_q(c) for c in columns])
    kept = fitted.kept(columns) if hasattr(fitted, "kept") else columns
    gone = set(columns) - set(kept)
    new = dict(zip(kept, made, strict=True))
    out = df.select(*[new[c].alias(c) if c in new else _q(c) for c in df.columns if c not in gone])
    if validate:
        check_finite_output(out, kept, what)
    return out, kept


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row mu0, var0, ...: mean and population variance of each column."""
    return df.agg(*[x for k, c in enumerate(columns) for x in (
        F.avg(_q(c)).alias(f"mu{k}"), F.var_pop(_q(c)).alias(f"var{k}"))])


def _moments(df: DataFrame, columns: Sequence[str], what: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    if not columns:
        return (), ()
    found = moments(df, columns).first().asDict()
    means, variances = [], []
    for k, c in enumerate(columns):
        mean, var = found[f"mu{k}"], found[f"var{k}"]
        if mean is None:
            raise ValidationError(f"{what} of feature {c!r} needs a row", "fit on a non-empty dataset").within("feature", k)
        if not (math.isfinite(mean) and math.isfinite(var)):
            raise NumericalError(f"mean or variance of feature {c!r} is not finite", "impute and rescale it first").within("feature", k)
        means.append(float(mean))
        variances.append(max(0.0, float(var)))
    return tuple(means), tuple(variances)


@dataclass(frozen=True)
class StandardScaler:
    """Subtract the mean and divide by the population standard deviation; constant columns by 1."""

    with_mean: bool = True
    with_std: bool = True

    def fit(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, weight: str | None = None, seed: int = 0):
        _no_weights(weight, "a scaler")
        means, variances = _moments(df, columns, "scaling")
        return FittedScaler(self, means, variances, tuple(math.sqrt(v) if v > 0 else 1.0 for v in variances), schema)


@dataclass(frozen=True)
class FittedScaler:
    spec: StandardScaler
    mean: tuple[float, ...]
    variance: tuple[float, ...]
    scale: tuple[float, ...]
    schema: FeatureSchema

    @property
    def output_schema(self) -> FeatureSchema:
        return self.schema

    def expressions(self, inputs: Sequence[Column]) -> list[Column]:
        out = []
        for x, m, s in zip(inputs, self.mean, self.scale, strict=True):
            x = x - F.lit(m) if self.spec.with_mean else x
            out.append(x / F.lit(s) if self.spec.with_std else x)
        return out

    def transform(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, validate: bool = False) -> tuple[DataFrame, list[str]]:
        return _apply(self, df, columns, schema, "scaling", validate)


@dataclass(frozen=True)
class VarianceThreshold:
    """Keep the features whose population variance is strictly above the threshold."""

    threshold: float = 0.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.threshold) and self.threshold >= 0):
            raise ValidationError("the variance threshold is negative or not finite", "use a finite value of 0 or more")

    def fit(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, weight: str | None = None, seed: int = 0):
        _no_weights(weight, "a variance filter")
        _, variances = _moments(df, columns, "the variance")
        chosen = tuple(k for k, v in enumerate(variances) if v > self.threshold)
        if not chosen:
            raise ValidationError("no feature's variance is above the threshold", "lower the threshold")
        return FittedVarianceThreshold(self, variances, chosen, schema)


@dataclass(frozen=True)
class FittedVarianceThreshold:
    spec: VarianceThreshold
    variances: tuple[float, ...]
    selected: tuple[int, ...]
    schema: FeatureSchema

    @property
    def output_schema(self) -> FeatureSchema:
        return self.schema.subset(self.selected)

    def kept(self, columns: Sequence[str]) -> list[str]:
        return [columns[k] for k in self.selected]

    def expressions(self, inputs: Sequence[Column]) -> list[Column]:
        return [inputs[k] for k in self.selected]

    def transform(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, validate: bool = False) -> tuple[DataFrame, list[str]]:
        return _apply(self, df, columns, schema, "variance filtering", validate)
