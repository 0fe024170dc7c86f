"""Ridge grids over all folds in a constant number of passes.

One pass takes statistics per fold, one the triangular factors per fold; that is all, whatever the
numbers of candidates and folds. Training factors of a fold are merged from the others on the driver, any
number of alphas reuses them, and the refit on all rows needs no pass either. Preprocessing (mean or
constant imputation, then scaling) is affine in the columns [1, x with 0 for missing, missing, y],
so it is applied to the factors; a residual is linear in the same columns, so the squared error of
a test fold is the squared length of its factor times the residual's coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ValidationError
from plumbline.functions.numeric import present
from plumbline.operators.linalg import qr_r, tsqr
from plumbline.operators.linear import solve_factor
from plumbline.operators.metrics import summarize
from plumbline.plans.selection import competition_ranks
from plumbline.sources.dataset import Dataset


@dataclass(frozen=True)
class RidgeGrid:
    """Scores are negative mean squared errors, [candidate][fold]; coefficients are those of the
    preprocessed features."""

    alphas: tuple[float, ...]
    scores: tuple[tuple[float, ...], ...]
    means: tuple[float, ...]
    ranks: tuple[int, ...]
    best: int
    coefficients: tuple[float, ...]
    intercept: float
    fold_coefficients: dict[tuple[int, int], tuple[tuple[float, ...], float]]


def _merge_stats(parts: list[dict], n: int) -> dict:
    """Counts, means and squared deviations of the union (Chan's rule), per column."""
    out = {"rows": 0, "top": 0.0, "count": np.zeros(n), "mean": np.zeros(n), "m2": np.zeros(n)}
    for p in parts:
        total = out["count"] + p["count"]
        delta = p["mean"] - out["mean"]
        safe = np.maximum(total, 1)
        out["m2"] += p["m2"] + delta ** 2 * out["count"] * p["count"] / safe
        out["mean"] += delta * p["count"] / safe
        out["count"] = total
        out["rows"] += p["rows"]
        out["top"] = max(out["top"], p["top"])
    return out


def ridge_grid(data: Dataset, assigned: DataFrame, alphas: Sequence[float], impute: str | None = "mean", constant: float = 0.0,
               scale: bool = True, fit_intercept: bool = True) -> RidgeGrid:
    """Cross-validated ridge for all ``alphas`` at once; equals separate fits up to rounding."""
    if impute not in (None, "mean", "constant"):
        raise ValidationError(f"imputation by {impute!r} doesn't merge over folds", "use mean or constant, or the plain search")
    x, y, n = list(data.features), data.target, len(data.features)
    w = F.lit(1.0) if data.weight is None else F.col(f"`{data.weight}`")
    # folds are joined once and kept: both passes read the same rows
    joined = data.df.join(assigned.select(data.row_id, "fold"), data.row_id).persist()
    stats = [F.count(F.lit(1)).alias("rows"), F.max(w).alias("top"), F.avg(f"`{y}`").alias("my")]
    for i, c in enumerate(x):
        v = present(F.col(f"`{c}`"))
        stats += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    per = {}
    for r in joined.groupBy("fold").agg(*stats).collect():
        count = np.array([r[f"n{i}"] for i in range(n)], float)
        per[r["fold"]] = {"rows": r["rows"], "top": float(r["top"]), "count": count, "my": r["my"],
                          "mean": np.array([r[f"m{i}"] or 0.0 for i in range(n)]),
                          "m2": np.array([(r[f"v{i}"] or 0.0) for i in range(n)]) * count}
    folds = sorted(per)
    everything = _merge_stats(list(per.values()), n)
    # a global shift keeps the factors well conditioned; it cancels in every fit
    shift, shift_y = everything["mean"], float(np.average([per[f]["my"] for f in folds], weights=[per[f]["rows"] for f in folds]))
    root = F.sqrt(w)
    cells = [F.col(f"`{c}`") for c in x]
    columns = [root, *(F.when(F.isnan(c), 0.0).otherwise(c - F.lit(float(s))) * root for c, s in zip(cells, shift, strict=True)),
               *(F.when(F.isnan(c), root).otherwise(0.0) for c in cells), (F.col(f"`{y}`") - F.lit(shift_y)) * root]
    factors = {f: found.r for f, found in tsqr(joined, columns, by="fold").items()}

    def prepare(train: dict, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Factor of [1, z, y] with z the preprocessed features, and z = (x or fill - centre) / spread."""
        if impute == "mean":
            if (train["count"] == 0).any():
                raise ValidationError("a feature has no value in a training part", "impute a constant")
            fill = train["mean"]
        else:
            fill = np.full(n, constant)
        missing = train["rows"] - train["count"]
        if impute is None and missing.any():
            raise ValidationError("a feature is missing and nothing imputes it", "choose an imputation")
        mean = (train["mean"] * train["count"] + fill * missing) / train["rows"]
        m2 = train["m2"] + (train["mean"] - mean) ** 2 * train["count"] + (fill - mean) ** 2 * missing
        variance = m2 / train["rows"]
        spread = np.where(variance > 0, np.sqrt(variance), 1.0) if scale else np.ones(n)
        centre = mean if scale else np.zeros(n)
        t = np.zeros((2 * n + 2, n + 2))
        t[0, 0] = t[-1, -1] = 1
        for i in range(n):
            t[0, 1 + i] = (shift[i] - centre[i]) / spread[i]
            t[1 + i, 1 + i] = 1 / spread[i]
            t[1 + n + i, 1 + i] = (fill[i] - shift[i]) / spread[i]
        t[0, -1] = shift_y
        return qr_r(r @ t), fill, centre, spread

    def solve(train: dict, r: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], tuple]:
        z, fill, centre, spread = prepare(train, r)
        out = []
        for alpha in alphas:
            top = max(train["top"], alpha)
            if fit_intercept:  # the first row absorbs the intercept: weighted centring
                beta, _, _ = solve_factor(z[1:, 1:] / math.sqrt(top), alpha, top, train["rows"])
                b = float((z[0, -1] - z[0, 1:-1] @ beta) / z[0, 0])
            else:
                beta, _, _ = solve_factor(qr_r(z[:, 1:]) / math.sqrt(top), alpha, top, train["rows"])
                b = 0.0
            out.append((beta, b))
        return out, (fill, centre, spread)

    joined.unpersist()
    scores: list[list[float]] = [[] for _ in alphas]
    fitted = {}
    for f in folds:
        others = [k for k in folds if k != f]
        train = _merge_stats([per[k] for k in others], n)
        found, (fill, centre, spread) = solve(train, qr_r(np.vstack([factors[k] for k in others])))
        weight = float(factors[f][:, 0] @ factors[f][:, 0])
        if not weight > 0:
            raise ValidationError("a test part has no positive weight", "choose fewer folds or another splitter")
        for j, (beta, b) in enumerate(found):
            fitted[j, f] = (tuple(map(float, beta)), b)
            slope = beta / spread
            residual = np.r_[b + slope @ (shift - centre) - shift_y, slope, slope * (fill - shift), -1.0]
            error = factors[f] @ residual
            scores[j].append(-float(error @ error) / weight)
    scores = tuple(map(tuple, scores))
    means = tuple(summarize(s).mean for s in scores)
    ranks = tuple(competition_ranks(means))
    best = ranks.index(1)
    beta, b = solve(everything, qr_r(np.vstack([factors[k] for k in folds])))[0][best]
    return RidgeGrid(tuple(alphas), scores, means, ranks, best, tuple(map(float, beta)), b, fitted)
