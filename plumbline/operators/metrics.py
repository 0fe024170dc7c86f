"""Metrics, curves and scorers as single aggregates over a DataFrame of truths and predictions.

Column names default to truth, pred (a value or label), p (the positive label's probability) and
weight None. ``undefined`` says what an undefined metric gives: "error", "nan" or "fallback".
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.errors import NumericalError, ValidationError
from plumbline.functions.numeric import compensated_sum, is_finite
from plumbline.sources.scratch import materialise

ERROR, NAN, FALLBACK = "error", "nan", "fallback"
_EPSILON = 2.220446049250313e-16


def undefined_value(policy: str, metric: str, reason: str, fallback: float) -> float:
    if policy == ERROR:
        raise ValidationError(f"{metric} is undefined: {reason}", "choose another policy for undefined metrics")
    if policy not in (NAN, FALLBACK):
        raise ValidationError(f"unknown policy {policy!r}", f"use {ERROR}, {NAN} or {FALLBACK}")
    return math.nan if policy == NAN else fallback


def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _finite(value: float | None, metric: str) -> float:
    if value is None:
        raise ValidationError(f"{metric} of no rows", "score at least one row of positive weight")
    if not math.isfinite(value):
        raise NumericalError(f"{metric} is not finite", "check the predictions")
    return float(value)


def weighted_average(df: DataFrame, value: Column, weight: str | None = None) -> DataFrame:
    """One row, column ``value``: the weighted mean; null if the weights sum to zero."""
    w = _w(weight)
    return df.agg(F.try_divide(F.sum(w * value), F.sum(w)).alias("value"))


# -- regression ------------------------------------------------------------------------------------
def mae_frame(df: DataFrame, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    return weighted_average(df, F.abs(F.col(pred) - F.col(truth)), weight)


def mse_frame(df: DataFrame, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    return weighted_average(df, (F.col(pred) - F.col(truth)) * (F.col(pred) - F.col(truth)), weight)


def mean_absolute_error(df, truth="truth", pred="pred", weight=None) -> float:
    return _finite(mae_frame(df, truth, pred, weight).first()[0], "mean absolute error")


def mean_squared_error(df, truth="truth", pred="pred", weight=None) -> float:
    return _finite(mse_frame(df, truth, pred, weight).first()[0], "mean squared error")


def root_mean_squared_error(df, truth="truth", pred="pred", weight=None) -> float:
    return math.sqrt(mean_squared_error(df, truth, pred, weight))


def r2_parts(df: DataFrame, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """One row: residual and total sums of squares. The mean comes first, as its own aggregate, so
    the total isn't a difference of two large sums."""
    w, y, p = _w(weight), F.col(truth), F.col(pred)
    mean = df.agg(F.try_divide(F.sum(w * y), F.sum(w))).first()[0]
    mean = F.lit(mean).cast("double")
    return df.agg(F.sum(w * (p - y) * (p - y)).alias("residual"), F.sum(w * (y - mean) * (y - mean)).alias("total"))


def r2(df, truth="truth", pred="pred", weight=None, undefined: str = ERROR) -> float:
    found = r2_parts(df, truth, pred, weight).first()
    residual, total = _finite(found["residual"], "R2"), _finite(found["total"], "R2")
    if total == 0:
        return undefined_value(undefined, "R2", "the truth is constant", 1.0 if residual == 0 else 0.0)
    return 1 - residual / total


def residual_curve(df: DataFrame, truth: str = "truth", pred: str = "pred", validate: bool = True) -> DataFrame:
    """(prediction, residual = truth - prediction) for every row, unweighted."""
    out = df.select(F.col(pred).alias("prediction"), (F.col(truth) - F.col(pred)).alias("residual"))
    if validate and out.where(~is_finite(F.col("residual"))).take(1):
        raise NumericalError("a residual is not finite", "check truths and predictions")
    return out


# -- binary classification -------------------------------------------------------------------------
def check_labels(df: DataFrame, columns: Sequence[str], positive: int | None = None) -> None:
    """At most two labels over all columns; with ``positive``, at most one other."""
    labels = df.select(F.explode(F.array(*[F.col(c).cast("long") for c in columns])).alias("l")).distinct().limit(4).collect()
    found = {r["l"] for r in labels}
    if len(found if positive is None else found - {positive}) > (2 if positive is None else 1):
        raise ValidationError(f"more than two labels: {sorted(found, key=str)}", "score one binary problem at a time")


def check_probabilities(df: DataFrame, p: str = "p") -> None:
    c = F.col(p)
    if df.where(~F.coalesce(is_finite(c) & (c >= 0) & (c <= 1), F.lit(False))).take(1):
        raise ValidationError("a probability is missing or outside [0, 1]", "pass the positive label's probability")


def confusion_frame(df: DataFrame, positive: int = 1, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """One row tp, tn, fp, fn: weighted counts in one pass."""
    w, t, p = _w(weight), F.col(truth) == positive, F.col(pred) == positive
    return df.agg(*[F.coalesce(F.sum(F.when(c, w).otherwise(0.0)), F.lit(0.0)).alias(n) for n, c in (
        ("tp", t & p), ("tn", ~t & ~p), ("fp", ~t & p), ("fn", t & ~p))])


def _confusion(df, positive, truth, pred, weight) -> tuple[float, float, float, float]:
    check_labels(df, [truth, pred], positive)
    return tuple(confusion_frame(df, positive, truth, pred, weight).first())


def accuracy(df, truth="truth", pred="pred", weight=None) -> float:
    check_labels(df, [truth, pred])
    hit = F.when(F.col(truth) == F.col(pred), 1.0).otherwise(0.0)
    return _finite(weighted_average(df, hit, weight).first()[0], "accuracy")


def balanced_accuracy(df, positive=1, truth="truth", pred="pred", weight=None, undefined: str = ERROR) -> float:
    tp, tn, fp, fn = _confusion(df, positive, truth, pred, weight)
    if tp + fn == 0 or tn + fp == 0:
        return undefined_value(undefined, "balanced accuracy", "a class has no weight", 0.0)
    return 0.5 * (tp / (tp + fn) + tn / (tn + fp))


def precision(df, positive=1, truth="truth", pred="pred", weight=None, undefined: str = ERROR) -> float:
    tp, _, fp, _ = _confusion(df, positive, truth, pred, weight)
    return tp / (tp + fp) if tp + fp else undefined_value(undefined, "precision", "nothing is predicted positive", 0.0)


def recall(df, positive=1, truth="truth", pred="pred", weight=None, undefined: str = ERROR) -> float:
    tp, _, _, fn = _confusion(df, positive, truth, pred, weight)
    return tp / (tp + fn) if tp + fn else undefined_value(undefined, "recall", "nothing is positive", 0.0)


def f1(df, positive=1, truth="truth", pred="pred", weight=None, undefined: str = ERROR) -> float:
    tp, _, fp, fn = _confusion(df, positive, truth, pred, weight)
    whole = 2 * tp + fp + fn
    return 2 * tp / whole if whole else undefined_value(undefined, "F1", "nothing is or is predicted positive", 0.0)


def log_loss_frame(df: DataFrame, positive: int = 1, truth: str = "truth", p: str = "p", weight: str | None = None) -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(_EPSILON)), F.lit(1 - _EPSILON))
    loss = F.when(F.col(truth) == positive, -F.ln(clipped)).otherwise(-F.log1p(-clipped))
    return weighted_average(df, loss, weight)


def log_loss(df, positive=1, truth="truth", p="p", weight=None) -> float:
    check_probabilities(df, p)
    check_labels(df, [truth], positive)
    return _finite(log_loss_frame(df, positive, truth, p, weight).first()[0], "log loss")


def _ranked(df: DataFrame, positive: int, truth: str, score: str, weight: str | None) -> DataFrame:
    """(score, tp, fp): weights of each distinct score; rows of zero weight take no part."""
    w = _w(weight)
    t = F.col(truth) == positive
    return (df.where(w > 0).groupBy(F.col(score).alias("score"))
            .agg(F.sum(F.when(t, w).otherwise(0.0)).alias("tp"), F.sum(F.when(~t, w).otherwise(0.0)).alias("fp")))


def _running(column: str) -> Column:
    """The sum over a range's scores from the highest down to the row's own."""
    return F.sum(column).over(Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))


def _ranges(ranked: DataFrame) -> DataFrame:
    """``ranked`` in range partitions by falling score, with the partition's number ``_part``."""
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked.repartitionByRange(n, F.desc("score")).withColumn("_part", F.spark_partition_id())


def _points(df, positive, truth, score, weight) -> tuple[DataFrame, dict[str, float]]:
    """Running tp and fp by falling score, and their totals, without a single-task window: the range partitions
    are written with their numbers (drawing the ranges again might deal scores otherwise), and each
    adds the sums of those before it."""
    parts = materialise(_ranges(_ranked(df, positive, truth, score, weight)), "ranked")
    sums = parts.groupBy("_part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).orderBy("_part").collect()
    before: dict[str, list[float]] = {c: [0.0] * (max((r["_part"] for r in sums), default=0) + 1) for c in ("tp", "fp")}
    totals = {"tp": 0.0, "fp": 0.0}
    for r in sums:
        for c in totals:
            before[c][r["_part"]] = totals[c]
            totals[c] += r[c]
    return parts.select("score", *[
        (_running(c) + F.get(F.array(*[F.lit(x) for x in before[c]]), F.col("_part"))).alias(c) for c in totals],
        *[F.lit(totals[c]).alias(f"total_{c}") for c in totals]), totals


def roc_curve(df: DataFrame, positive: int = 1, truth: str = "truth", p: str = "p", weight: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) by falling threshold, from (infinity, 0, 0); no point is dropped.

    Both classes must have weight.
    """
    points, totals = _points(df, positive, truth, p, weight)
    if not totals["tp"] or not totals["fp"]:
        raise ValidationError("a ROC curve needs both classes", "score rows of both classes")
    start = df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("total_fp")).alias("fpr"),
                                           (F.col("tp") / F.col("total_tp")).alias("tpr")))


def pr_curve(df: DataFrame, positive: int = 1, truth: str = "truth", p: str = "p", weight: str | None = None) -> DataFrame:
    """(threshold, precision, recall) by rising threshold; the end point (null, 1, 0) comes last."""
    points, totals = _points(df, positive, truth, p, weight)
    if not totals["tp"]:
        raise ValidationError("a precision-recall curve needs positive rows", "score rows of the positive class")
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                         (F.col("tp") / F.col("total_tp")).alias("recall")).unionByName(end)


def _areas(df, positive, truth, p, weight) -> list:
    """For each range of scores, from the highest: its tp and fp, and the area under its own curve. The area is a
    sum over rows (trapezoids need the running sum without half the row's own weight), so ranges
    add up: a later range's fp count once more for each tp before it. One job."""
    own = _running("tp") - F.col("tp") / 2
    return (_ranges(_ranked(df, positive, truth, p, weight)).select("_part", "tp", "fp", (F.col("fp") * own).alias("area"))
            .groupBy("_part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("area").alias("area"))
            .orderBy("_part").collect())


def auc_value(df, positive=1, truth="truth", p="p", weight=None) -> float | None:
    """The area under the ROC curve; None if a class has no weight."""
    tp = fp = area = 0.0
    for r in _areas(df, positive, truth, p, weight):
        area += r["area"] + r["fp"] * tp
        tp, fp = tp + r["tp"], fp + r["fp"]
    return area / (tp * fp) if tp and fp else None


def roc_auc(df, positive=1, truth="truth", p="p", weight=None, undefined: str = ERROR) -> float:
    check_probabilities(df, p)
    check_labels(df, [truth], positive)
    value = auc_value(df, positive, truth, p, weight)
    if value is None:
        return undefined_value(undefined, "ROC AUC", "only one class has weight", 0.5)
    return _finite(value, "ROC AUC")


@dataclass(frozen=True)
class BinaryPredictions:
    """Truths beside predicted labels, probabilities of the positive label, or both, as columns of one
    DataFrame, so they are aligned by construction. At least one kind must be there.

    ``scores`` gives all binary metrics that the columns allow.
    """

    df: DataFrame
    truth: str = "truth"
    labels: str | None = None
    probabilities: str | None = None
    weight: str | None = None
    positive: int = 1

    def __post_init__(self) -> None:
        if self.labels is None and self.probabilities is None:
            raise ValidationError("neither labels nor probabilities", "name at least one column of predictions")
        for c in (self.truth, self.labels, self.probabilities, self.weight):
            if c is not None and c not in self.df.columns:
                raise ValidationError(f"no column {c!r}", "pass a DataFrame with all columns")

    def _needs(self, column: str | None, what: str) -> str:
        if column is None:
            raise ValidationError(f"the predictions have no {what}", f"name a column of {what}")
        return column

    def frame(self, needs: str) -> DataFrame:
        """truth, weight and pred (``needs`` "label") or p ("probability")."""
        column = self._needs(self.labels, "labels") if needs == "label" else self._needs(self.probabilities, "probabilities")
        weight = [F.col(f"`{self.weight}`").alias("weight")] if self.weight else []
        return self.df.select(F.col(f"`{self.truth}`").alias("truth"), F.col(f"`{column}`").alias("pred" if needs == "label" else "p"), *weight)

    def score(self, scorer: Scorer) -> float:
        return scorer(self.frame(scorer.needs), "weight" if self.weight else None)

    def scores(self, undefined: str = ERROR) -> dict[str, float]:
        there = {"label": self.labels, "probability": self.probabilities}
        return {name: self.score(s) for name, s in binary_scorers(self.positive, undefined).items() if there[s.needs] is not None}


# -- scorers ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scorer:
    """A named score, greater is better. ``needs`` is "value", "label" or "probability"."""

    name: str
    needs: str
    score: Callable[..., float]
    positive: int | None = None
    undefined: str = ERROR

    def __call__(self, df: DataFrame, weight: str | None = None) -> float:
        extra: dict = {} if self.positive is None else {"positive": self.positive}
        if self.name in ("r2", "balanced_accuracy", "precision", "recall", "f1", "roc_auc"):
            extra["undefined"] = self.undefined
        return self.score(df, weight=weight, **extra)


def _negated(f: Callable[..., float]) -> Callable[..., float]:
    return lambda *a, **b: -f(*a, **b)


def regression_scorers(undefined: str = ERROR) -> dict[str, Scorer]:
    made = (Scorer("neg_mean_absolute_error", "value", _negated(mean_absolute_error)),
            Scorer("neg_mean_squared_error", "value", _negated(mean_squared_error)),
            Scorer("neg_root_mean_squared_error", "value", _negated(root_mean_squared_error)),
            Scorer("r2", "value", r2, undefined=undefined))
    return {s.name: s for s in made}


def binary_scorers(positive: int = 1, undefined: str = ERROR) -> dict[str, Scorer]:
    made = (Scorer("accuracy", "label", accuracy), Scorer("balanced_accuracy", "label", balanced_accuracy, positive, undefined),
            Scorer("precision", "label", precision, positive, undefined), Scorer("recall", "label", recall, positive, undefined),
            Scorer("f1", "label", f1, positive, undefined), Scorer("neg_log_loss", "probability", _negated(log_loss), positive),
            Scorer("roc_auc", "probability", roc_auc, positive, undefined))
    return {s.name: s for s in made}


@dataclass(frozen=True)
class Summary:
    count: int
    mean: float
    standard_deviation: float
    minimum: float
    maximum: float


def summarize(scores: Sequence[float], undefined: str = ERROR) -> Summary:
    """Count, mean, population standard deviation and range of fold scores."""
    if not scores:
        raise ValidationError("no scores to summarize", "provide a score per fold")
    for i, s in enumerate(scores):
        if math.isinf(s):
            raise ValidationError(f"score {i} is infinite", "provide finite scores")
    if any(math.isnan(s) for s in scores):
        if undefined == ERROR:
            raise ValidationError("a score is undefined", "resolve it or choose a policy")
        if undefined == NAN:
            return Summary(len(scores), math.nan, math.nan, math.nan, math.nan)
        scores = [0.0 if math.isnan(s) else s for s in scores]
    mean = compensated_sum(scores) / len(scores)
    variance = compensated_sum([(s - mean) ** 2 for s in scores]) / len(scores)
    if not (math.isfinite(mean) and math.isfinite(variance)):
        raise NumericalError("the summary is not finite", "check the scores")
    return Summary(len(scores), mean, math.sqrt(max(variance, 0.0)), min(scores), max(scores))


def summarize_frame(df: DataFrame, score: str = "score") -> DataFrame:
    """The same summary as one aggregate over a table of scores."""
    s = F.col(score)
    return df.agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("standard_deviation"),
                  F.min(s).alias("minimum"), F.max(s).alias("maximum"))
