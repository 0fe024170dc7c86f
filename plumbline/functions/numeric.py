"""Sums and products of columns, compensated where rounding matters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compensated_sum(values: Sequence[float] | np.ndarray) -> float:
    """Neumaier's sum in the given order. Infinities of both signs, or a NaN, give NaN."""
    total = correction = 0.0
    for x in map(float, values):
        new = total + x
        if math.isinf(new) or math.isnan(new):
            infinite = {v for v in map(float, values) if math.isinf(v)}
            if any(math.isnan(float(v)) for v in values) or len(infinite) == 2:
                return math.nan
            return infinite.pop() if infinite else new
        correction += (total - new) + x if abs(total) >= abs(x) else (x - new) + total
        total = new
    return total + correction


def dot(a: Sequence[float], b: Sequence[float]) -> float:
    """Compensated dot product of equally long sequences."""
    if len(a) != len(b):
        raise ValueError("dot product of different lengths")
    return compensated_sum([x * y for x, y in zip(a, b, strict=True)])


#: Marks of sums that aren't finite, beside the exponents of doubles.
_PLUS, _MINUS, _NAN = 5000, 5001, 5002
_HALF = 26  #: bits of the lower part of a mantissa


def _binned(values: np.ndarray) -> dict[int, tuple[int, int]]:
    """Exact sums of a block of doubles: for each binary exponent the sums of the upper and lower parts of the
    53-bit mantissas, as whole numbers."""
    out: dict[int, tuple[int, int]] = {}
    finite = np.isfinite(values)
    if not finite.all():
        for mark, n in ((_PLUS, (values == np.inf).sum()), (_MINUS, (values == -np.inf).sum()), (_NAN, np.isnan(values).sum())):
            if n:
                out[mark] = (int(n), 0)
        values = values[finite]
    fraction, exponent = np.frexp(values)
    whole = (fraction * 2.0 ** 53).astype(np.int64)
    for e in np.unique(exponent[whole != 0]).tolist():
        own = whole[exponent == e]
        out[e] = (int((own >> _HALF).sum()), int((own & ((1 << _HALF) - 1)).sum()))
    return out


def exact_column_sums(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Correctly rounded sums of double columns, whatever the partitions and their order.

    Each task adds mantissas as whole numbers, one bin for each binary exponent; the bins add up on
    the executors as decimals, and the driver gets a row for each column and exponent. Infinities of
    both signs, or a NaN, give NaN; nulls count as zero.
    """
    names = list(columns)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[tuple[int, int], list[int]] = {}
        for batch in frames:
            for k in range(len(names)):
                for e, (high, low) in _binned(batch.column(k).drop_null().to_numpy(zero_copy_only=False)).items():
                    own = bins.setdefault((k, e), [0, 0])
                    own[0] += high
                    own[1] += low
        rows = [(k, e, Decimal(high), Decimal(low)) for (k, e), (high, low) in bins.items()]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "e", "high", "low"])

    found = (df.select(*[F.col(f"`{c}`").cast("double") for c in names])
             .mapInArrow(run, "k int, e int, high decimal(38,0), low decimal(38,0)")
             .groupBy("k", "e").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    totals = [0] * len(names)  # in units of the least double
    marks: list[set[int]] = [set() for _ in names]
    for r in found:
        if r["e"] >= _PLUS:
            marks[r["k"]].add(r["e"])
        else:
            totals[r["k"]] += ((int(r["high"]) << _HALF) + int(r["low"])) << (r["e"] + 1073 + 53)
    return [_special(m) if m else _quotient(t) for m, t in zip(marks, totals, strict=True)]


def _special(marks: set[int]) -> float:
    return math.nan if marks != {_PLUS} and marks != {_MINUS} else math.inf if marks == {_PLUS} else -math.inf


def _quotient(total: int) -> float:
    """``total`` in units of 2**-1179 as the nearest double."""
    try:
        return total / (1 << (1073 + 53 + 53))
    except OverflowError:
        return math.inf if total > 0 else -math.inf


#: Terms up to which a weighted sum is one expression; longer ones are a fold over arrays, so no plan is deep.
_TERMS = 100


def linear(columns: Sequence[str], values: Sequence[float], start: float = 0.0) -> Column:
    """``start`` plus the weighted sum of columns in their order, one projection."""
    if len(columns) > _TERMS:
        products = F.zip_with(F.array(*[F.col(f"`{c}`") for c in columns]), F.array(*[F.lit(float(v)) for v in values]), lambda x, v: x * v)
        return F.aggregate(products, F.lit(float(start)), lambda a, x: a + x)
    out = F.lit(float(start))
    for c, v in zip(columns, values, strict=True):
        out = out + F.col(f"`{c}`") * F.lit(float(v))
    return out


def matrix_vector(df: DataFrame, columns: Sequence[str], values: Sequence[float], name: str = "product") -> DataFrame:
    """Compensated row products beside the other columns: Neumaier's sum, a fold inside one projection."""
    if len(columns) != len(values):
        raise ValueError("a product of different lengths")
    products = F.zip_with(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]),
                          F.array(*[F.lit(float(v)) for v in values]), lambda x, v: x * v)

    def add(a: Column, x: Column) -> Column:
        total = a["total"] + x
        lost = F.when(F.abs(a["total"]) >= F.abs(x), (a["total"] - total) + x).otherwise((x - total) + a["total"])
        return F.struct(total.alias("total"), (a["lost"] + lost).alias("lost"))

    zero = F.lit(0.0)
    # where the sum isn't finite, its correction is NaN: infinities of one sign stay, others give NaN
    done = F.aggregate(products, F.struct(zero.alias("total"), zero.alias("lost")), add,
                       lambda a: F.when(is_finite(a["total"]), a["total"] + a["lost"]).otherwise(a["total"]))
    return df.withColumn(name, done)


def transposed_matrix_vector(df: DataFrame, columns: Sequence[str], vector: str) -> list[float]:
    """Column products: one pass of exact sums."""
    products = df.select(*[(F.col(f"`{c}`") * F.col(f"`{vector}`")).alias(f"p{i}") for i, c in enumerate(columns)])
    return exact_column_sums(products, products.columns)


def dot_columns(df: DataFrame, a: str, b: str) -> float:
    """Dot product of two columns, exactly summed."""
    return transposed_matrix_vector(df, [a], b)[0]


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & ~is_infinite(c)


def present(c: Column) -> Column:
    """The value, null where it is missing (NaN), so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) that never overflows."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
