"""A versioned, bounded, data-only file format for fitted pipelines.

Envelope: magic, major, minor, task, payload length, checksum kind, MD5 of the payload, payload. All
integers are big-endian; text and arrays have 64-bit lengths. Nothing in a file is executed.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from plumbline.errors import ArtifactError, ValidationError, WorkflowError
from plumbline.operators import linear, preprocess
from plumbline.plans.pipeline import FittedPipeline
from plumbline.schema import NAMESPACE, FeatureSchema

PRODUCER = "0.1.0"
#: Fixed values of the format.
MAJOR, MINOR, MD5_KIND, ENVELOPE = 1, 0, 1, 36
TASKS = {"regression": 1, "classification": 2}
TAGS = {"imputer": 1, "scaler": 2, "variance": 3, "ols": 16, "ridge": 17, "logistic": 18}
STRATEGIES = ("mean", "median", "constant")
REASONS = (linear.DIRECT, linear.GRADIENT, linear.STEP)


@dataclass(frozen=True)
class Limits:
    """What a reader accepts."""

    max_bytes: int = 64 << 20
    max_components: int = 1024
    max_features: int = 1_000_000
    max_string_bytes: int = 1 << 20
    max_metadata_entries: int = 128

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValidationError(f"artifact {f.name} isn't positive", "use positive limits")


@dataclass(frozen=True)
class Format:
    """Names of the format; files of another producer with the same layout are read by its names."""

    magic: bytes = b"PLUMBL01"
    namespace: tuple[str, str] = NAMESPACE


@dataclass(frozen=True)
class Metadata:
    training_rows: int | None = None
    root_seed: int | None = None
    sample_weighted: bool | None = None
    labels: tuple[tuple[str, str], ...] = ()


def _bad(operation: str, message: str) -> ArtifactError:
    return ArtifactError(message, "use a valid artifact of a supported version", operation=operation)


class _Writer:
    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def u8(self, v: int) -> None:
        self.parts.append(bytes([v]))

    def i64(self, v: int) -> None:
        self.parts.append(struct.pack(">q", v))

    def f64(self, v: float) -> None:
        self.parts.append(struct.pack(">d", v))

    def raw(self, v: bytes) -> None:
        self.i64(len(v))
        self.parts.append(v)

    def text(self, v: str) -> None:
        self.raw(v.encode())

    def floats(self, v) -> None:
        self.i64(len(v))
        self.parts.append(struct.pack(f">{len(v)}d", *v))

    def ints(self, v) -> None:
        self.i64(len(v))
        self.parts.append(struct.pack(f">{len(v)}q", *v))

    def bytes(self) -> bytes:
        return b"".join(self.parts)


class _Reader:
    def __init__(self, data: bytes, limits: Limits) -> None:
        self.data, self.at, self.limits = data, 0, limits

    def take(self, n: int) -> bytes:
        if n < 0 or n > len(self.data) - self.at:
            raise _bad("decode", "the artifact is cut off")
        self.at += n
        return self.data[self.at - n:self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def flag(self) -> bool:
        v = self.u8()
        if v > 1:
            raise _bad("decode", "a flag is neither 0 nor 1")
        return bool(v)

    def i64(self) -> int:
        return struct.unpack(">q", self.take(8))[0]

    def f64(self) -> float:
        return struct.unpack(">d", self.take(8))[0]

    def length(self, what: str, most: int) -> int:
        n = self.i64()
        if not 0 <= n <= most:
            raise _bad("decode", f"the {what} {n} is negative or above the limit {most}")
        return n

    def raw(self) -> bytes:
        return self.take(self.length("component size", self.limits.max_bytes))

    def text(self) -> str:
        try:
            return self.take(self.length("text size", self.limits.max_string_bytes)).decode()
        except UnicodeDecodeError as error:
            raise _bad("decode", "a text isn't UTF-8") from error

    def floats(self) -> tuple[float, ...]:
        n = self.length("array size", self.limits.max_features)
        return struct.unpack(f">{n}d", self.take(8 * n))

    def ints(self) -> tuple[int, ...]:
        n = self.length("array size", self.limits.max_features)
        return struct.unpack(f">{n}q", self.take(8 * n))

    def finish(self) -> None:
        if self.at != len(self.data):
            raise _bad("decode", "bytes are left over")


# -- parts -----------------------------------------------------------------------------------------
def _write_schema(w: _Writer, s: FeatureSchema, form: Format, limits: Limits) -> None:
    if s.width > limits.max_features:
        raise _bad("encode", "too many features for the reader's limit")
    w.i64(s.width)
    w.u8(s.names is not None)
    if s.names is not None:
        w.i64(len(s.names))
        for name in s.names:
            if len(name.encode()) > limits.max_string_bytes:
                raise _bad("encode", "a feature name is above the reader's limit")
            w.text(name)
    w.text(s.fingerprint(form.namespace))


def _read_schema(r: _Reader, form: Format) -> FeatureSchema:
    width = r.length("feature count", r.limits.max_features)
    named = r.flag()
    if named:
        n = r.length("name count", r.limits.max_features)
        if n != width:
            raise _bad("decode", "name count and feature count differ")
    try:
        schema = FeatureSchema(width, tuple(r.text() for _ in range(width)) if named else None)
    except WorkflowError as error:
        raise _bad("decode", str(error)) from error
    if r.text() != schema.fingerprint(form.namespace):
        raise _bad("decode", "the schema's fingerprint doesn't match")
    return schema


def _write_report(w: _Writer, report: linear.SolverReport) -> None:
    w.u8(report.converged)
    w.i64(report.iterations)
    w.f64(report.objective)
    w.u8(REASONS.index(report.reason))
    w.u8(report.rank is not None)
    if report.rank is not None:
        w.i64(report.rank)


def _read_report(r: _Reader) -> linear.SolverReport:
    converged, iterations, objective, reason = r.flag(), r.i64(), r.f64(), r.u8()
    if reason >= len(REASONS):
        raise _bad("decode", "unknown stopping reason")
    rank = r.i64() if r.flag() else None
    if not converged or iterations < 0 or not math.isfinite(objective) or (rank is not None and rank < 0):
        raise _bad("decode", "the solver report is invalid")
    return linear.SolverReport(iterations, objective, REASONS[reason], rank)


def _imputer(w: _Writer, f: preprocess.FittedImputer) -> int:
    w.u8(STRATEGIES.index(f.spec.strategy))
    if f.spec.strategy == "constant":
        w.f64(f.spec.value)
    w.floats(f.values)
    return TAGS["imputer"]


def _scaler(w: _Writer, f: preprocess.FittedScaler) -> int:
    w.u8(f.spec.with_mean)
    w.u8(f.spec.with_std)
    for values in (f.mean, f.variance, f.scale):
        w.floats(values)
    return TAGS["scaler"]


def _variance(w: _Writer, f: preprocess.FittedVarianceThreshold) -> int:
    w.f64(f.spec.threshold)
    w.floats(f.variances)
    w.ints(f.selected)
    return TAGS["variance"]


def _linear(w: _Writer, f: linear.FittedLinear) -> int:
    ridge = isinstance(f.spec, linear.RidgeRegression)
    if ridge:
        w.f64(f.spec.alpha)
    w.u8(f.spec.fit_intercept)
    w.floats(f.coefficients)
    w.f64(f.intercept)
    _write_report(w, f.report)
    return TAGS["ridge" if ridge else "ols"]


def _logistic(w: _Writer, f: linear.FittedLogistic) -> int:
    w.f64(f.spec.c)
    w.u8(f.spec.fit_intercept)
    w.f64(f.spec.tolerance)
    w.i64(f.spec.max_iterations)
    w.floats(f.coefficients)
    w.f64(f.intercept)
    w.ints(f.classes)
    _write_report(w, f.report)
    return TAGS["logistic"]


_ENCODERS: dict[type, Callable[[_Writer, Any], int]] = {
    preprocess.FittedImputer: _imputer, preprocess.FittedScaler: _scaler, preprocess.FittedVarianceThreshold: _variance,
    linear.FittedLinear: _linear, linear.FittedLogistic: _logistic}


def _write_component(w: _Writer, name: str, fitted: Any) -> None:
    encode = _ENCODERS.get(type(fitted))
    if encode is None:
        raise _bad("encode", f"stage {name!r} has no codec")
    own = _Writer()
    w.u8(encode(own, fitted))
    w.i64(1)
    w.raw(own.bytes())


def _finite(*groups) -> bool:
    return all(math.isfinite(v) for g in groups for v in g)


def _read_transformer(tag: int, r: _Reader, before: FeatureSchema, after: FeatureSchema) -> Any:
    n = before.width
    if tag == TAGS["imputer"]:
        kind = r.u8()
        if kind >= len(STRATEGIES):
            raise _bad("decode", "unknown imputer strategy")
        value = r.f64() if STRATEGIES[kind] == "constant" else 0.0
        values = r.floats()
        if len(values) != n or before != after or not _finite(values, [value]):
            raise _bad("decode", "the imputer is invalid")
        return preprocess.FittedImputer(preprocess.SimpleImputer(STRATEGIES[kind], value), values, before)
    if tag == TAGS["scaler"]:
        with_mean, with_std = r.flag(), r.flag()
        mean, variance, scale = r.floats(), r.floats(), r.floats()
        if ({len(mean), len(variance), len(scale)} != {n} or before != after or not _finite(mean, variance, scale)
                or min(variance, default=0) < 0 or min(scale, default=1) <= 0):
            raise _bad("decode", "the scaler is invalid")
        return preprocess.FittedScaler(preprocess.StandardScaler(with_mean, with_std), mean, variance, scale, before)
    if tag == TAGS["variance"]:
        threshold, variances, selected = r.f64(), r.floats(), r.ints()
        rising = all(a < b for a, b in zip(selected, selected[1:], strict=False))
        if (not math.isfinite(threshold) or threshold < 0 or len(variances) != n or not selected or not rising
                or not _finite(variances) or min(variances) < 0 or selected[0] < 0 or selected[-1] >= n
                or before.subset(selected) != after):
            raise _bad("decode", "the variance filter is invalid")
        return preprocess.FittedVarianceThreshold(preprocess.VarianceThreshold(threshold), variances, selected, before)
    raise _bad("decode", f"unknown transformer tag {tag}")


def _read_estimator(tag: int, r: _Reader, schema: FeatureSchema, task: str) -> Any:
    if task == "regression" and tag in (TAGS["ols"], TAGS["ridge"]):
        alpha = r.f64() if tag == TAGS["ridge"] else 0.0
        intercepted, beta, b, report = r.flag(), r.floats(), r.f64(), _read_report(r)
        if (not math.isfinite(alpha) or alpha < 0 or len(beta) != schema.width or not _finite(beta, [b])
                or report.reason != linear.DIRECT or report.rank is None or report.rank > schema.width
                or report.iterations != 1 or report.objective < 0):
            raise _bad("decode", "the linear model is invalid")
        spec = linear.RidgeRegression(alpha, intercepted) if tag == TAGS["ridge"] else linear.LinearRegression(intercepted)
        return linear.FittedLinear(spec, beta, b, schema, report)
    if task == "classification" and tag == TAGS["logistic"]:
        c, intercepted, tolerance, most = r.f64(), r.flag(), r.f64(), r.i64()
        beta, b, classes, report = r.floats(), r.f64(), r.ints(), _read_report(r)
        if (not _finite([c, tolerance, b], beta) or c <= 0 or tolerance <= 0 or most <= 0 or len(classes) != 2
                or classes[0] >= classes[1] or len(beta) != schema.width or report.rank is not None
                or report.reason == linear.DIRECT or report.iterations > most or report.objective < 0):
            raise _bad("decode", "the logistic model is invalid")
        return linear.FittedLogistic(linear.LogisticRegression(c, intercepted, tolerance, most), beta, b, classes, schema, report)
    raise _bad("decode", f"tag {tag} is no {task} estimator")


# -- whole artifacts -------------------------------------------------------------------------------
def encode(model: FittedPipeline, metadata: Metadata = Metadata(), limits: Limits = Limits(), form: Format = Format()) -> bytes:
    """All bytes of the artifact; equal models give equal bytes."""
    if len(metadata.labels) > limits.max_metadata_entries:
        raise _bad("encode", "too many metadata entries for the reader's limit")
    if len(model.stages) >= limits.max_components:
        raise _bad("encode", "too many components for the reader's limit")
    w = _Writer()
    w.text(PRODUCER)
    w.text("")
    for value in (metadata.training_rows, metadata.root_seed):
        w.u8(value is not None)
        if value is not None:
            w.i64(value)
    w.u8({None: 0, False: 1, True: 2}[metadata.sample_weighted])
    w.i64(len(metadata.labels))
    for pair in metadata.labels:
        for text in pair:
            if len(text.encode()) > limits.max_string_bytes:
                raise _bad("encode", "a metadata text is above the reader's limit")
            w.text(text)
    _write_schema(w, model.schema, form, limits)
    _write_schema(w, model.output_schema, form, limits)
    w.i64(len(model.stages))
    for name, stage in model.stages:
        w.text(name)
        _write_schema(w, stage.schema, form, limits)
        _write_schema(w, stage.output_schema, form, limits)
        _write_component(w, name, stage)
    name, terminal = model.estimator
    w.text(name)
    _write_component(w, name, terminal)
    payload = w.bytes()
    if len(payload) + ENVELOPE > limits.max_bytes:
        raise _bad("encode", "the artifact is above the reader's limit")
    head = _Writer()
    head.parts.append(form.magic)
    for v in (MAJOR, MINOR, TASKS[terminal.task]):
        head.u8(v)
    head.i64(len(payload))
    head.u8(MD5_KIND)
    return head.bytes() + hashlib.md5(payload).digest() + payload


def _component(r: _Reader) -> tuple[int, _Reader]:
    tag = r.u8()
    if r.length("component version", 65535) != 1:
        raise _bad("decode", "unsupported component version")
    return tag, _Reader(r.raw(), r.limits)


def decode(data: bytes, task: str | None = None, limits: Limits = Limits(), form: Format = Format()) -> tuple[FittedPipeline, Metadata]:
    """The pipeline and its metadata; every value is checked, nothing is trusted."""
    if len(data) > limits.max_bytes:
        raise _bad("decode", "the artifact is above the reader's limit")
    if len(data) < ENVELOPE:
        raise _bad("decode", "the artifact is cut off")
    r = _Reader(data, limits)
    if r.take(len(form.magic)) != form.magic:
        raise _bad("decode", "no artifact of this format")
    major, minor, kind = r.u8(), r.u8(), r.u8()
    if major != MAJOR or minor > MINOR:
        raise _bad("decode", f"unsupported version {major}.{minor}")
    names = {v: k for k, v in TASKS.items()}
    if kind not in names or (task is not None and names[kind] != task):
        raise _bad("decode", "the artifact is of another task")
    size = r.i64()
    if r.u8() != MD5_KIND:
        raise _bad("decode", "unknown checksum")
    checksum = r.take(16)
    payload = r.take(size)
    r.finish()
    if hashlib.md5(payload).digest() != checksum:
        raise _bad("decode", "the checksum doesn't match")
    r = _Reader(payload, limits)
    r.text()
    r.text()
    rows = r.length("row count", (1 << 62)) if r.flag() else None
    if rows == 0:
        raise _bad("decode", "the training row count is zero")
    seed = r.i64() if r.flag() else None
    weighted = r.u8()
    if weighted > 2:
        raise _bad("decode", "the weight metadata is invalid")
    labels = tuple((r.text(), r.text()) for _ in range(r.length("metadata count", limits.max_metadata_entries)))
    schema, output = _read_schema(r, form), _read_schema(r, form)
    stages, at, seen = [], schema, set()
    for _ in range(r.length("component count", limits.max_components - 1)):
        name, before, after = r.text(), _read_schema(r, form), _read_schema(r, form)
        if not name.strip() or name in seen:
            raise _bad("decode", "a stage name is blank or repeated")
        if before != at:
            raise _bad("decode", "the stages' schemas don't follow each other")
        seen.add(name)
        tag, own = _component(r)
        stages.append((name, _read_transformer(tag, own, before, after)))
        own.finish()
        at = after
    if at != output:
        raise _bad("decode", "the output schema doesn't match the stages")
    name = r.text()
    if not name.strip() or name in seen:
        raise _bad("decode", "the estimator's name is blank or repeated")
    tag, own = _component(r)
    terminal = _read_estimator(tag, own, output, names[kind])
    own.finish()
    r.finish()
    return (FittedPipeline(tuple(stages), (name, terminal), schema, output),
            Metadata(rows, seed, {0: None, 1: False, 2: True}[weighted], labels))


def save(model: FittedPipeline, path: str, metadata: Metadata = Metadata(), limits: Limits = Limits(), form: Format = Format()) -> None:
    """Encode fully, then write."""
    data = encode(model, metadata, limits, form)
    with open(path, "wb") as file:
        file.write(data)


def load(path: str, task: str | None = None, limits: Limits = Limits(), form: Format = Format()) -> tuple[FittedPipeline, Metadata]:
    """Read no more than the limit allows, then decode."""
    with open(path, "rb") as file:
        data = file.read(limits.max_bytes + 1)
    return decode(data, task, limits, form)
