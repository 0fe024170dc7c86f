"""Least squares at scale: QR on the executors, one small factor on the driver (TSQR)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = float(np.finfo(np.float64).eps)
#: Norms that agree to this relative difference tie; the lower column wins, so results don't
#: depend on partitions.
TIE = 1e-10


def qr_r(a: np.ndarray) -> np.ndarray:
    """The triangular factor of ``a``, with a square shape whatever its rows."""
    width = a.shape[1]
    r = np.linalg.qr(a, mode="r") if len(a) else np.zeros((0, width))
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


@dataclass
class Factor:
    """A triangular factor, with the rows that went into it and the largest value of its first column."""

    r: np.ndarray
    rows: int
    top: float

    def add(self, block: np.ndarray) -> None:
        self.r = qr_r(np.vstack([self.r, block]))
        self.rows += len(block)
        self.top = max(self.top, float(block[:, 0].max()))

    def merge(self, other: Factor) -> None:
        self.r = qr_r(np.vstack([self.r, other.r]))
        self.rows, self.top = self.rows + other.rows, max(self.top, other.top)

    @classmethod
    def empty(cls, width: int) -> Factor:
        return cls(np.zeros((0, width)), 0, -np.inf)


def tsqr(df: DataFrame, rows: Sequence[Column], by: str | None = None) -> dict[int, Factor]:
    """Triangular factors of the matrix whose columns are the expressions ``rows``.

    With ``by``, one factor for each value of that integer column (small non-negative numbers such
    as folds). Each task folds its batches into factors; factors of up to 64 salts meet on the
    executors, so the driver gets 64 per group at most, however many partitions there are.
    """
    width = len(rows)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Factor] = {}
        for batch in frames:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for key in np.unique(keys).tolist():
                parts.setdefault(key, Factor.empty(width)).add(block[keys == key])
        yield _factors(parts)

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Factor] = {}
        for batch in frames:
            for key, own in _read(batch, width):
                parts.setdefault(key, Factor.empty(width)).merge(own)
        yield _factors(parts)

    key = F.lit(0) if by is None else F.col(by)
    local = df.select(key.cast("int").alias("_key"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(rows)])
    schema = "key int, rows long, top double, r binary"
    partial = local.mapInArrow(fold, schema).withColumn("_salt", F.spark_partition_id() % 64)
    merged = partial.repartition("key", "_salt").drop("_salt").mapInArrow(merge, schema).toArrow()
    out: dict[int, Factor] = {}
    for key_, own in sorted(_read(merged, width), key=lambda x: (x[0], x[1].r.tobytes())):
        out.setdefault(key_, Factor.empty(width)).merge(own)
    return out


def _read(table: pa.RecordBatch | pa.Table, width: int) -> list[tuple[int, Factor]]:
    columns = (table.column(c).to_pylist() for c in ("key", "rows", "top", "r"))
    return [(key, Factor(np.frombuffer(raw).reshape(width, width), n, top)) for key, n, top, raw in zip(*columns, strict=True)]


def _factors(parts: dict[int, Factor]) -> pa.RecordBatch:
    found = list(parts.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts), pa.int32()), pa.array([f.rows for f in found], pa.int64()), pa.array([f.top for f in found], pa.float64()),
         pa.array([np.ascontiguousarray(f.r).tobytes() for f in found], pa.binary())], names=["key", "rows", "top", "r"])


def sum_vectors(df: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of rows of ``of(block)``, a vector of ``size`` numbers.

    Tasks add up their batches, 64 salts add up the tasks, the driver the salts.
    """

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in frames:
            if batch.num_rows:
                total += of(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in frames:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    partial = df.mapInArrow(fold, "v binary").withColumn("_salt", F.spark_partition_id() % 64)
    merged = partial.repartition("_salt").drop("_salt").mapInArrow(merge, "v binary").toArrow()
    return np.sum([np.frombuffer(raw) for raw in merged.column("v").to_pylist()], axis=0) if merged.num_rows else np.zeros(size)


def pivoted_solve(a: np.ndarray, b: np.ndarray, rows: int | None = None) -> tuple[np.ndarray, int]:
    """Basic least-squares solution and rank by Householder QR with column pivots.

    ``rows`` is the number of rows of the original problem, for the rank tolerance
    eps * max(rows, columns) * first pivot. Columns left out of the basis get zero.
    """
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    n = a.shape[1]
    order = list(range(n))
    tolerance, rank = 0.0, 0
    for k in range(min(a.shape)):
        norms = np.sqrt((a[k:, k:] ** 2).sum(axis=0))
        top = norms.max() if len(norms) else 0.0
        if k == 0:
            tolerance = _EPS * max(rows or a.shape[0], n) * top
        if not top > tolerance:
            break
        # of the columns that tie for the largest norm, the lowest original one
        pick = min((i for i in range(k, n) if norms[i - k] >= top * (1 - TIE)), key=lambda i: order[i])
        a[:, [k, pick]] = a[:, [pick, k]]
        order[k], order[pick] = order[pick], order[k]
        v = a[k:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        scale = v @ v
        if scale > 0:
            a[k:, k:] -= np.outer(v, (2 / scale) * (v @ a[k:, k:]))
            b[k:] -= v * ((2 / scale) * (v @ b[k:]))
        rank += 1
    out = np.zeros(n)
    if rank:
        out[order[:rank]] = np.linalg.solve(np.triu(a[:rank, :rank]), b[:rank])
    return out, rank
