"""Exact order statistics without sorting: the key at given ranks, for every group of rows.

Sketches bracket each wanted rank; a pass counts what lies below a bracket and, key by key, what lies
inside. Nothing is shuffled but counts, so a split at a rank becomes a comparison with a literal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys inside all brackets that the driver gets; more are narrowed first.
MOST = 500_000
_GRID = [i / 100 for i in range(101)]
_ACCURACY = 1000


@dataclass
class _Bracket:
    group: int
    rank: int
    low: int
    high: int
    below: int  #: keys below ``low``, if known
    inside: int  #: keys from ``low`` to ``high``, about
    done: bool = False  #: whether a sketch can't narrow it any more

    def narrowed(self, quantiles: Sequence[int]) -> tuple[int, int]:
        """The part of the bracket around the rank, by its own quantiles."""
        i = int(100 * (self.rank - self.below) / max(1, self.inside))
        return quantiles[max(0, i - 1)] if i > 1 else self.low, quantiles[i + 2] if i < 98 else self.high


@dataclass(frozen=True)
class Group:
    """A group's number of rows, its least key, and its keys at the wanted ranks."""

    rows: int
    least: int
    keys: tuple[int | None, ...]


def order_statistics(df: DataFrame, key: str, ranks: Callable[[dict[int, tuple[int, int]]], dict[int, Sequence[int]]],
                     group: str | None = None, most: int = MOST, max_groups: int = 10_000) -> dict[int, Group]:
    """For each group (a whole-number column; None: one group 0) the keys (whole numbers) at its ranks from 0.

    ``ranks`` gets group -> (rows, least key) and gives the ranks of each group; a rank that a group
    doesn't have gives None. One pass where keys are dense, else two, and more only for brackets of
    over ``most`` keys. More than ``max_groups`` groups are an error.
    """
    rows = df.select((F.col(f"`{group}`") if group else F.lit(0)).cast("long").alias("g"), F.col(f"`{key}`").cast("long").alias("x"))
    found = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.percentile_approx("x", _GRID, _ACCURACY).alias("q")).limit(max_groups + 1).collect()
    if len(found) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    wanted = ranks({r["g"]: (r["n"], r["low"]) for r in found})
    keys: dict[int, dict[int, int]] = {r["g"]: {} for r in found}
    open_: list[_Bracket] = []
    for r in found:
        for rank in {x for x in wanted[r["g"]] if 0 <= x < r["n"]}:
            if r["high"] - r["low"] + 1 == r["n"]:  # unique whole numbers without a gap
                keys[r["g"]][rank] = r["low"] + rank
                continue
            b = _Bracket(r["g"], rank, r["low"], r["high"], 0, r["n"])
            b.low, b.high = b.narrowed(r["q"])
            b.inside = r["n"] // 25
            open_.append(b)
    spark = df.sparkSession
    while open_:
        # at most max_groups rows: safe to broadcast
        table: dict[int, list] = {}
        for j, b in enumerate(open_):
            table.setdefault(b.group, []).append((j, b.low, b.high))
        brackets = F.broadcast(spark.createDataFrame(list(table.items()), "g long, b array<struct<j:int,low:long,high:long>>"))
        near = (rows.join(brackets, "g").select("x", F.explode("b").alias("b")).where(F.col("x") <= F.col("b.high"))
                .select("b.j", F.when(F.col("x") >= F.col("b.low"), F.col("x")).alias("x")))
        if sum(b.inside for b in open_ if not b.done) > most:
            counts = near.groupBy("j").agg(F.count_if(F.col("x").isNull()).alias("below"), F.count("x").alias("n"),
                                           F.percentile_approx("x", _GRID, _ACCURACY).alias("q")).collect()
            for r in counts:
                b = open_[r["j"]]
                b.below, b.inside = r["below"], r["n"]
                if not b.below <= b.rank < b.below + b.inside:
                    raise RuntimeError("a sketch missed the rank that it was asked for")
                low, high = b.narrowed(r["q"])
                b.done = (low, high) == (b.low, b.high)
                b.inside //= 25
                b.low, b.high = low, high
            continue
        counted = near.groupBy("j", "x").agg(F.count(F.lit(1)).alias("n")).toArrow()
        js, xs, ns = (counted.column(c) for c in ("j", "x", "n"))
        null = np.array(xs.is_null())
        js, ns, xs = js.to_numpy(), ns.to_numpy(), xs.fill_null(0).to_numpy()
        missed = []
        for j, b in enumerate(open_):
            own = js == j
            below = int(ns[own & null].sum())
            order = np.argsort(xs[own & ~null], kind="stable")
            values, reached = xs[own & ~null][order], below + np.cumsum(ns[own & ~null][order])
            at = int(np.searchsorted(reached, b.rank, side="right"))
            if b.rank < below or at >= len(values):  # outside what the sketch promises: look everywhere
                missed.append(b)
            else:
                keys[b.group][b.rank] = int(values[at])
        by_group = {r["g"]: r for r in found}
        for b in missed:
            b.low, b.high, b.done = by_group[b.group]["low"], by_group[b.group]["high"], True
        open_ = missed
    return {r["g"]: Group(r["n"], r["low"], tuple(keys[r["g"]].get(x) for x in wanted[r["g"]])) for r in found}
