"""Cross-validation and grid search."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import CompatibilityError, DataError, ValidationError, WorkflowError, context
from plumbline.functions.seeds import derive
from plumbline.operators.metrics import Scorer, Summary, summarize
from plumbline.operators.splitters import Split, split_parts
from plumbline.plans.execution import Execution, Sequential
from plumbline.plans.pipeline import FittedPipeline, Pipeline
from plumbline.sources.dataset import Dataset

ABORT, RECORD = "abort", "record"


@dataclass(frozen=True)
class Failure:
    """Where a fold failed: "materialization", "fitting", "prediction" or "scoring"."""

    phase: str
    error: WorkflowError
    part: str | None = None
    scorer: str | None = None


@dataclass(frozen=True)
class FoldReport:
    """Times are wall seconds on the driver; they overlap when folds run at once."""

    fold: int
    test_scores: dict[str, float] = field(default_factory=dict)
    train_scores: dict[str, float] = field(default_factory=dict)
    failures: tuple[Failure, ...] = ()
    fit_seconds: float = 0.0
    score_seconds: float = 0.0
    model: FittedPipeline | None = None
    train_rows: list[int] | None = None
    test_rows: list[int] | None = None


@dataclass(frozen=True)
class CrossValidation:
    folds: tuple[FoldReport, ...]
    scorers: tuple[str, ...]

    def scores(self, name: str) -> list[float]:
        """Test scores of the folds that have one."""
        return [f.test_scores[name] for f in self.folds if name in f.test_scores]

    @property
    def successful(self) -> int:
        return sum(not f.failures and len(f.test_scores) == len(self.scorers) for f in self.folds)

    @property
    def mean_fit_seconds(self) -> float:
        return sum(f.fit_seconds for f in self.folds) / len(self.folds)

    @property
    def mean_score_seconds(self) -> float:
        return sum(f.score_seconds for f in self.folds) / len(self.folds)


def check_scorers(scorers: Sequence[Scorer]) -> None:
    if not scorers:
        raise ValidationError("no scorers", "pass at least one scorer")
    names = [s.name for s in scorers]
    for name in names:
        if names.count(name) > 1:
            raise ValidationError(f"two scorers are named {name!r}", "use unique names")


def score_model(model: FittedPipeline, data: Dataset, scorers: Sequence[Scorer]) -> tuple[dict[str, float], list[tuple[str, WorkflowError]]]:
    """Scores of a fitted pipeline on a dataset; only the responses that the scorers need are made.

    Prediction failures are raised; scoring failures are returned beside the scores.
    """
    needs = {s.needs for s in scorers}
    made = model.response([F.col(f"`{c}`") for c in data.features])
    columns = [F.col(f"`{data.target}`").alias("truth")]
    if data.weight:
        columns.append(F.col(f"`{data.weight}`").alias("weight"))
    if "value" in needs:
        if "value" not in made:
            raise CompatibilityError("the estimator predicts no values", "score classifiers with binary scorers")
        columns.append(made["value"].alias("pred"))
    if needs & {"label", "probability"}:
        if "label" not in made:
            raise CompatibilityError("the estimator predicts no labels", "score regressors with regression scorers")
        low, high = model.classes
        if "label" in needs:
            columns.append(made["label"].cast("long").alias("pred"))
        if "probability" in needs:
            positives = {s.positive for s in scorers if s.needs == "probability"}
            for positive in positives:
                if positive not in (low, high):
                    raise CompatibilityError(f"the model has no class {positive}", f"use {low} or {high} as positive label")
            p = made["probability"]
            columns += [(p if positive == high else 1 - p).alias(f"p{positive}") for positive in positives]
    frame = data.df.select(*columns)  # a projection of kept rows: each scorer is one pass over it
    scores, failures = {}, []
    if len(scorers) > 1:
        frame = frame.persist()
    try:
        for s in scorers:
            own = frame.withColumnRenamed(f"p{s.positive}", "p") if s.needs == "probability" else frame
            try:
                scores[s.name] = s(own, "weight" if data.weight else None)
            except WorkflowError as error:
                failures.append((s.name, error.within("stage", s.name)))
    finally:
        frame.unpersist()
    return scores, failures


def cross_validate(pipeline: Pipeline, data: Dataset, splitter: Any, scorers: Sequence[Scorer], seed: int = 0,
                   return_train_score: bool = False, return_models: bool = False, return_indices: bool = False,
                   failure_policy: str = ABORT, fit_seed: int | None = None, execution: Execution | None = None) -> CrossValidation:
    """Fit and score every fold of ``splitter``.

    With "abort" the first failure of the lowest fold is raised with its fold as context; with
    "record" it is kept in the report and the other folds go on.
    """
    check_scorers(scorers)
    if failure_policy not in (ABORT, RECORD):
        raise ValidationError(f"unknown failure policy {failure_policy!r}", f"use {ABORT} or {RECORD}")
    folded = fold_frame(data, splitter.assign(data, derive(seed, "cross-validation-splitter")))
    try:
        return cross_validate_folds(pipeline, data, folded, scorers, seed, return_train_score, return_models, return_indices,
                                    failure_policy, fit_seed, execution)
    finally:
        folded.df.unpersist()


@dataclass(frozen=True)
class Folded:
    """A dataset beside its folds, kept once for all folds; ``weights`` are (rows, rows of positive
    weight) of the train and test part of each fold."""

    df: DataFrame
    parts: list[Split]
    weights: list[dict[str, tuple[int, int]]]


def fold_frame(data: Dataset, assigned: DataFrame) -> Folded:
    """Join the folds once, keep the result, and count every part in one aggregate."""
    joined = data.df.join(assigned, data.row_id).persist()
    timed = "part" in assigned.columns
    positive = F.count_if(F.col(f"`{data.weight}`") > 0) if data.weight else F.count(F.lit(1))
    found = joined.groupBy("fold", *(["part"] if timed else [])).agg(F.count(F.lit(1)).alias("n"), positive.alias("p")).collect()
    folds = sorted({r["fold"] for r in found})

    def counted(f: int, part: str) -> tuple[int, int]:
        own = [r for r in found if (r["fold"] == f and r["part"] == part if timed else (r["fold"] == f) == (part == "test"))]
        return sum(r["n"] for r in own), sum(r["p"] for r in own)

    weights = [{part: counted(f, part) for part in ("train", "test")} for f in folds]
    return Folded(joined, split_parts(data, joined, folds), weights)


def _check_parts(data: Dataset, weights: dict[str, tuple[int, int]]) -> None:
    """What can be wrong with a part of an admitted dataset: it has no row, or no positive weight."""
    for part, (n, positive) in weights.items():
        if not n:
            raise ValidationError(f"the {part} part is empty", "choose fewer folds or another splitter")
        if data.weight and not positive:
            raise DataError("all-zero weights", f"no weight of the {part} part is positive", "choose fewer folds or another splitter")


def cross_validate_folds(pipeline: Pipeline, data: Dataset, folded: Folded, scorers: Sequence[Scorer], seed: int = 0,
                         return_train_score: bool = False, return_models: bool = False, return_indices: bool = False,
                         failure_policy: str = ABORT, fit_seed: int | None = None, execution: Execution | None = None) -> CrossValidation:
    """:func:`cross_validate` on folds that are known already; a grid search shares them."""
    root = seed if fit_seed is None else fit_seed

    def one(i: int, split: Split) -> FoldReport:
        with context("fold", i):
            return _fold(i, split, folded.weights[i], pipeline, scorers, derive(root, "cross-validation-fold", i), return_train_score,
                         return_models, return_indices, failure_policy)

    folds = (execution or Sequential()).map(one, folded.parts)
    return CrossValidation(tuple(folds), tuple(s.name for s in scorers))


def _fold(i, parts, weights, pipeline, scorers, seed, with_train, with_model, with_rows, policy) -> FoldReport:
    report = FoldReport(i)
    failures: list[Failure] = []

    def failed(phase: str, error: WorkflowError, part: str | None = None, scorer: str | None = None) -> None:
        if policy == ABORT:
            raise error
        failures.append(Failure(phase, error, part, scorer))

    try:
        _check_parts(parts.train, weights)
    except WorkflowError as error:
        failed("materialization", error)
        return replace(report, failures=tuple(failures))
    if with_rows:
        rid = parts.train.row_id
        report = replace(report, train_rows=[r[0] for r in parts.train.df.select(rid).orderBy(rid).collect()],
                         test_rows=[r[0] for r in parts.test.df.select(rid).orderBy(rid).collect()])
    began = time.perf_counter()
    try:
        model = pipeline.fit(parts.train, seed)
    except WorkflowError as error:
        failed("fitting", error)
        return replace(report, failures=tuple(failures), fit_seconds=time.perf_counter() - began)
    report = replace(report, fit_seconds=time.perf_counter() - began, model=model if with_model else None)
    began = time.perf_counter()
    found: dict[str, dict[str, float]] = {"train": {}, "test": {}}
    scoring: dict[str, list] = {"train": [], "test": []}
    wanted = [("train", parts.train)] * with_train + [("test", parts.test)]
    for part, own in wanted:
        try:
            found[part], scoring[part] = score_model(model, own, scorers)
        except WorkflowError as error:  # once, not for every scorer
            failed("prediction", error, part)
    for part, _ in wanted:
        for name, error in scoring[part]:
            failed("scoring", error, part, name)
    return replace(report, test_scores=found["test"], train_scores=found["train"], failures=tuple(failures),
                   score_seconds=time.perf_counter() - began)


# -- grid search -----------------------------------------------------------------------------------
Parameters = dict[str, bool | int | float | str]


def grid(axes: Sequence[tuple[str, Sequence[Any]]]) -> list[Parameters]:
    """All combinations, the last axis fastest; no axes give one empty combination."""
    names = [n for n, _ in axes]
    if len(set(names)) < len(names):
        raise ValidationError("two axes have one name", "use unique axis names")
    for name, values in axes:
        if not values:
            raise ValidationError(f"axis {name!r} is empty", "give every axis a value")
        for v in values:
            if not isinstance(v, bool | int | float | str):
                raise ValidationError(f"axis {name!r} has a {type(v).__name__}", "use bool, int, float or str values")
    if math.prod(len(v) for _, v in axes) >= 1 << 62:
        raise ValidationError("the grid is too large", "use fewer values")
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*(v for _, v in axes))]


@dataclass(frozen=True)
class Candidate:
    index: int
    parameters: Parameters
    report: CrossValidation | None = None
    error: WorkflowError | None = None
    summaries: dict[str, Summary] = field(default_factory=dict)
    rank: int | None = None


@dataclass(frozen=True)
class GridSearch:
    candidates: tuple[Candidate, ...]
    best: int | None
    model: FittedPipeline | None
    refit_error: WorkflowError | None = None


def competition_ranks(means: Sequence[float | None]) -> list[int | None]:
    """1 + the number of better scores; None where there is no score. Equal scores share a rank."""
    known = [m for m in means if m is not None]
    return [None if m is None else 1 + sum(x > m for x in known) for m in means]


def search(build: Callable[[Parameters], Pipeline], axes: Sequence[tuple[str, Sequence[Any]]], data: Dataset, splitter: Any,
           scorers: Sequence[Scorer], refit: str, seed: int = 0, failure_policy: str = RECORD,
           return_train_score: bool = False, execution: Execution | None = None) -> GridSearch:
    """Cross-validate every combination on the same folds, rank by mean test score of ``refit`` (ties to
    the first), and fit the winner on all rows. A candidate with a failed fold or an undefined
    score has no rank. Ridge grids have a constant number of passes in ``plans.fusion``.
    """
    check_scorers(scorers)
    if refit not in {s.name for s in scorers}:
        raise ValidationError(f"no scorer is named {refit!r}", "refit by one of the scorers")
    if failure_policy not in (ABORT, RECORD):
        raise ValidationError(f"unknown failure policy {failure_policy!r}", f"use {ABORT} or {RECORD}")
    candidates: list[Candidate] = []
    combinations = grid(axes)
    folded = fold_frame(data, splitter.assign(data, derive(seed, "cross-validation-splitter")))
    try:
        _search_all(candidates, build, combinations, data, folded, scorers, seed, failure_policy, return_train_score, execution)
    finally:
        folded.df.unpersist()
    ranks = competition_ranks([c.summaries[refit].mean if refit in c.summaries else None for c in candidates])
    candidates = [replace(c, rank=r) for c, r in zip(candidates, ranks, strict=True)]
    best = next((c.index for c in candidates if c.rank == 1), None)
    if best is None:
        if failure_policy == ABORT:
            raise ValidationError("no candidate could be ranked", "resolve the failed folds")
        return GridSearch(tuple(candidates), None, None)
    try:
        model = build(candidates[best].parameters).fit(data, derive(seed, "grid-search-refit", best))
    except WorkflowError as error:
        if failure_policy == ABORT:
            raise
        return GridSearch(tuple(candidates), best, None, error)
    return GridSearch(tuple(candidates), best, model)


def _search_all(candidates, build, combinations, data, folded, scorers, seed, failure_policy, return_train_score, execution) -> None:
    for i, parameters in enumerate(combinations):
        with context("candidate", i):
            try:
                built = build(parameters)
                report = cross_validate_folds(built, data, folded, scorers, seed, return_train_score, failure_policy=failure_policy,
                                              fit_seed=derive(seed, "grid-search-candidate", i), execution=execution)
            except WorkflowError as error:
                if failure_policy == ABORT:
                    raise
                candidates.append(Candidate(i, parameters, error=error))
                continue
        summaries = {}
        if report.successful == len(report.folds):
            for s in scorers:
                try:
                    summaries[s.name] = summarize(report.scores(s.name))
                except WorkflowError:
                    continue
        candidates.append(Candidate(i, parameters, report, summaries=summaries))
