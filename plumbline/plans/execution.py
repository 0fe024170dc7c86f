"""How independent Spark jobs run: one after another, or from a bounded pool of driver threads."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import SparkSession

from plumbline.errors import CancelledError, ValidationError

#: Environment variables that limit threads of numerical libraries (fixed values, by name).
THREAD_VARIABLES = ("BLIS_NUM_THREADS", "MKL_NUM_THREADS", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "VECLIB_MAXIMUM_THREADS")
_LARGEST = (1 << 62) - 1


@runtime_checkable
class Execution(Protocol):
    def concurrency(self) -> int: ...

    def map(self, f: Callable[[int, Any], Any], inputs: Sequence[Any]) -> list[Any]: ...


class Sequential:
    """In order; the first failure ends it."""

    def concurrency(self) -> int:
        return 1

    def map(self, f: Callable[[int, Any], Any], inputs: Sequence[Any]) -> list[Any]:
        return [f(i, x) for i, x in enumerate(inputs)]


@dataclass(frozen=True)
class Diagnostics:
    workers: int
    recommended: int
    inner_threads: int
    inner_source: str
    runnable: int
    warnings: tuple[tuple[str, dict], ...]


def diagnose(workers: int, inner_threads: int | None, recommended: int, environment: Mapping[str, str]) -> Diagnostics:
    """Oversubscription: workers times inner threads against what the cluster runs at once."""
    warnings: list[tuple[str, dict]] = []
    source = "explicit"
    if inner_threads is None:
        limits: dict[str, int] = {}
        for name in THREAD_VARIABLES:
            if name in environment:
                text = environment[name].strip()
                if text.isdigit() and int(text) > 0:
                    limits[name] = int(text)
                else:
                    warnings.append(("invalid environment limit", {"variable": name, "value": environment[name]}))
        source = "environment" if limits else "assumed sequential"
        inner_threads = max(limits.values(), default=1)
        if len(set(limits.values())) > 1:
            warnings.append(("conflicting environment limits", limits))
    runnable = min(workers * inner_threads, _LARGEST)
    if workers > recommended:
        warnings.append(("workers exceed recommended", {"requested": workers, "recommended": recommended}))
    if workers > 1 and inner_threads > 1:
        warnings.append(("nested parallelism", {"workers": workers, "inner_threads": inner_threads}))
    if runnable > recommended:
        warnings.append(("potential oversubscription", {"runnable": runnable, "recommended": recommended}))
    return Diagnostics(workers, recommended, inner_threads, source, runnable, tuple(warnings))


class BoundedPool:
    """Jobs from ``workers`` threads. Results keep the order of the inputs; of several failures the
    one with the lowest index is raised, and inputs above a failure are skipped."""

    def __init__(self, workers: int, inner_threads: int | None = None, spark: SparkSession | None = None) -> None:
        if workers < 1:
            raise ValidationError(f"{workers} workers", "use one worker or more")
        if inner_threads is not None and inner_threads < 1:
            raise ValidationError(f"{inner_threads} inner threads", "use one thread or more")
        recommended = spark.sparkContext.defaultParallelism if spark else os.cpu_count() or 1
        self.workers = workers
        self.diagnostics = diagnose(workers, inner_threads, max(1, recommended), os.environ)

    def concurrency(self) -> int:
        return self.workers

    def map(self, f: Callable[[int, Any], Any], inputs: Sequence[Any]) -> list[Any]:
        if self.workers == 1:
            return Sequential().map(f, inputs)
        lock, lowest = Lock(), [len(inputs)]

        def one(i: int) -> tuple[Any, BaseException | None]:
            if i > lowest[0]:
                return None, CancelledError("an earlier part failed")
            try:
                return f(i, inputs[i]), None
            except Exception as error:  # noqa: BLE001 - raised below, lowest index first
                with lock:
                    lowest[0] = min(lowest[0], i)
                return None, error

        with ThreadPoolExecutor(self.workers) as pool:
            done = list(pool.map(one, range(len(inputs))))
        if lowest[0] < len(inputs):
            raise done[lowest[0]][1]
        return [x for x, _ in done]
