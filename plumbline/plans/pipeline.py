"""Pipelines: named transformers and one terminal estimator, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import CompatibilityError, SchemaError, ValidationError, context
from plumbline.functions.numeric import sigmoid
from plumbline.functions.seeds import derive
from plumbline.schema import FeatureSchema
from plumbline.sources.dataset import Dataset


@runtime_checkable
class Transformer(Protocol):
    """Anything with this ``fit`` can be a stage; its result needs schema, output_schema and
    transform, and expressions if it is to fuse into one projection."""

    def fit(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, weight: str | None = None, seed: int = 0) -> Any: ...


@runtime_checkable
class Estimator(Protocol):
    """A terminal stage; ``task`` is "regression" or "classification"."""

    task: str

    def fit(self, df: DataFrame, columns: Sequence[str], target: str, schema: FeatureSchema, weight: str | None = None,
            seed: int = 0) -> Any: ...


@dataclass(frozen=True)
class Pipeline:
    """An immutable builder."""

    stages: tuple[tuple[str, Any], ...] = ()
    estimator: tuple[str, Any] | None = None

    def _name(self, name: str) -> None:
        if not name.strip():
            raise ValidationError("a stage name is blank", "name every stage")
        taken = {n for n, _ in self.stages} | ({self.estimator[0]} if self.estimator else set())
        if name in taken:
            raise ValidationError(f"two stages are named {name!r}", "use unique names")

    def add(self, name: str, transformer: Any) -> Pipeline:
        self._name(name)
        return replace(self, stages=(*self.stages, (name, transformer)))

    def set_estimator(self, name: str, estimator: Any) -> Pipeline:
        if self.estimator is not None:
            raise ValidationError("the pipeline has its estimator", "set one estimator")
        self._name(name)
        return replace(self, estimator=(name, estimator))

    def fit(self, data: Dataset, seed: int = 0) -> FittedPipeline:
        """Each transformer learns from the training rows as the earlier ones transform them; only
        the estimator sees weights. Transforms stay lazy, so a stage costs one aggregate."""
        if self.estimator is None:
            raise ValidationError("the pipeline has no estimator", "set one before fitting")
        name, estimator = self.estimator
        if estimator.task != data.task:
            raise CompatibilityError(f"a {estimator.task} estimator can't fit a {data.task} target", "match the tasks")
        df, columns, schema = data.df, list(data.features), data.schema
        fitted = []
        for i, (stage, transformer) in enumerate(self.stages):
            with context("stage", stage):
                learnt = transformer.fit(df, columns, schema, seed=derive(seed, f"pipeline-transformer:{stage}", i))
                df, columns = learnt.transform(df, columns, schema)
                if len(columns) != learnt.output_schema.width:
                    raise SchemaError("a transformer's width differs from its schema", "return the columns of output_schema")
                schema = learnt.output_schema
            fitted.append((stage, learnt))
        with context("stage", name):
            terminal = estimator.fit(df, columns, data.target, schema, data.weight,
                                     seed=derive(seed, f"pipeline-estimator:{name}", len(self.stages)))
        return FittedPipeline(tuple(fitted), (name, terminal), data.schema, schema)


@dataclass(frozen=True)
class FittedPipeline:
    stages: tuple[tuple[str, Any], ...]
    estimator: tuple[str, Any]
    schema: FeatureSchema
    output_schema: FeatureSchema
    metadata: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, columns: Sequence[str], schema: FeatureSchema, validate: bool = False) -> tuple[DataFrame, list[str]]:
        """The transformed features in place of the given ones; Catalyst folds all stages into one
        projection."""
        self.schema.require(schema, "the pipeline")
        columns = list(columns)
        for name, stage in self.stages:
            with context("stage", name):
                df, columns = stage.transform(df, columns, schema, validate)
                schema = stage.output_schema
        return df, columns

    def _terminal(self, method: str) -> Any:
        name, terminal = self.estimator
        if not hasattr(terminal, method):
            raise CompatibilityError(f"{name!r} has no {method}", "use an estimator with that capability").within("stage", name)
        return getattr(terminal, method)

    def _apply(self, method: str, df, columns, schema, validate, **extra) -> DataFrame:
        call = self._terminal(method)
        out, kept = self.transform(df, columns, schema, validate)
        with context("stage", self.estimator[0]):
            return call(out, kept, self.output_schema, validate=validate, **extra)

    def predict(self, df, columns, schema, name="prediction", validate=False) -> DataFrame:
        return self._apply("predict", df, columns, schema, validate, name=name)

    def decision_function(self, df, columns, schema, name="decision", validate=False) -> DataFrame:
        return self._apply("decision_function", df, columns, schema, validate, name=name)

    def predict_proba(self, df, columns, schema, names=("p_low", "p_high"), validate=False) -> DataFrame:
        return self._apply("predict_proba", df, columns, schema, validate, names=names)

    @property
    def classes(self) -> tuple[int, int]:
        return self._terminal("classes")

    def response(self, inputs: Sequence[Column]) -> dict[str, Column]:
        """Responses as expressions of raw feature columns: value, or label and probability. Lets
        many models score in one projection."""
        for _, stage in self.stages:
            inputs = stage.expressions(inputs)
        _, terminal = self.estimator
        if hasattr(terminal, "prediction"):
            return {"value": terminal.prediction(inputs)}
        z = terminal.decision(inputs)
        return {"label": F.when(z > 0, terminal.classes[1]).otherwise(terminal.classes[0]), "probability": sigmoid(z)}
