"""Fold assignment. Splits depend on row ids and seeds only, never on partitions.

Every splitter returns a DataFrame (row_id, fold): the fold in which a row is tested; the
time-series splitter returns (row_id, fold, part), as a row may train several folds. Folds in id order
begin at ids that are found by exact order statistics, so they are projections and move no row;
shuffled ones go through a range-partitioned dense index. No window runs in a single task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ShapeError, ValidationError
from plumbline.functions.order import order_statistics
from plumbline.functions.seeds import derive, permutation
from plumbline.sources.dataset import Dataset, with_dense_index

#: Rows that the exact Fisher-Yates mode takes, as its order, sequential by definition, is made on the driver.
EXACT_ROWS = 5_000_000
#: Classes of a stratified split, whose table is broadcast.
MAX_CLASSES = 10_000


def _folds(folds: int, n: int) -> None:
    if folds < 2:
        raise ValidationError(f"{folds} folds", "use two folds or more")
    if folds > n:
        raise ValidationError(f"{folds} folds for {n} rows", "use as many folds as rows at most")


def shuffle_key(row_id: str, seed: int) -> Column:
    """An order that depends on the seed and the row's id alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def _block(idx: Column, n: Column | int, k: int) -> Column:
    """Fold of a dense index: contiguous blocks, the first n mod k one row longer."""
    n = F.lit(n) if isinstance(n, int) else n
    q, r = F.floor(n / F.lit(k)), n % k
    head = r * (q + 1)
    return F.when(idx < head, F.floor(idx / (q + 1))).otherwise(r + F.floor((idx - head) / F.greatest(q, F.lit(1)))).cast("int")


def _reached(key: Column, cuts: Sequence[int | None]) -> Column:
    """How many of the ascending cut points the key has reached; None is never reached."""
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + (key >= F.lit(c).cast("long")).cast("int")
    return out.cast("int")


def _shuffled(indexed: DataFrame, seeds: dict[int, tuple[int, int]], group: str) -> DataFrame:
    """``indexed`` with ``idx`` replaced by the row's place in a Fisher-Yates shuffle of its group.

    ``seeds``: group -> (rows, seed). The shuffle is sequential by definition, so the driver makes
    the order, of indices only, group by group; rows get it by a join on their index.
    """
    total = sum(n for n, _ in seeds.values())
    if total > EXACT_ROWS:
        raise ValidationError(f"exact shuffling of {total} rows", f"use it for {EXACT_ROWS} rows at most, or the default order")
    orders = {g: permutation(n, seed) for g, (n, seed) in seeds.items()}
    table = pd.DataFrame({group: np.concatenate([np.full(len(o), g) for g, o in orders.items()]),
                          "idx": np.concatenate(list(orders.values())), "_to": np.concatenate([np.arange(len(o)) for o in orders.values()])})
    return indexed.join(indexed.sparkSession.createDataFrame(table), [group, "idx"]).drop("idx").withColumnRenamed("_to", "idx")


@dataclass(frozen=True)
class KFold:
    """Contiguous folds, or with ``shuffle`` the same rule in a shuffled order.

    The default shuffle sorts by a digest of seed and row id; ``exact`` is Fisher-Yates.
    """

    folds: int = 5
    shuffle: bool = False
    exact: bool = False

    def starts(self, n: int) -> list[int]:
        """The first place of every fold but the first."""
        _folds(self.folds, n)
        q, r = divmod(n, self.folds)
        return [f * q + min(f, r) for f in range(1, self.folds)]

    def assign(self, data: Dataset, seed: int = 0) -> DataFrame:
        rid = data.row_id
        rows = data.df.select(rid)
        if not self.shuffle:
            # the folds begin at ids: no row is moved
            found = order_statistics(rows, rid, lambda groups: {g: self.starts(n) for g, (n, _) in groups.items()})
            if not found:
                _folds(self.folds, 0)
            return rows.select(rid, _reached(F.col(rid), found[0].keys).alias("fold"))
        n = data.rows if data.rows is not None else data.df.count()
        _folds(self.folds, n)
        if self.exact:
            indexed = with_dense_index(rows, [rid])
            indexed = _shuffled(indexed.withColumn("_c", F.lit(0).cast("long")), {0: (n, seed)}, "_c")
        else:
            indexed = with_dense_index(rows.withColumn("_k", shuffle_key(rid, seed)), ["_k", rid])
        return indexed.select(rid, _block(F.col("idx"), n, self.folds).alias("fold"))


@dataclass(frozen=True)
class StratifiedKFold:
    """Classes, numbered by first appearance, fill the folds in blocks so that both fold sizes and
    class counts stay balanced; ``shuffle`` permutes the rows of each class by its child seed, in the
    order of a digest or, with ``exact``, by Fisher-Yates."""

    folds: int = 5
    shuffle: bool = False
    exact: bool = False

    def starts(self, groups: dict[int, tuple[int, int]]) -> dict[int, list[int]]:
        """For class -> (rows, first row): the first place of every fold in the class."""
        k, offset, out = self.folds, 0, {}
        for c, (size, _) in sorted(groups.items(), key=lambda g: g[1][1]):
            # fold f takes the places p of the class with (offset + p) mod k = f
            per = [size // k + ((f - offset) % k < size % k) for f in range(k)]
            out[c] = [int(x) for x in np.cumsum([0, *per[:-1]])]
            offset += size
        return out

    def assign(self, data: Dataset, seed: int = 0) -> DataFrame:
        rid, y = data.row_id, data.target
        rows = data.df.select(rid, F.col(f"`{y}`").alias("_c"))
        sizes: dict[int, tuple[int, int]] = {}

        def ranks(groups: dict[int, tuple[int, int]]) -> dict[int, Sequence[int]]:
            sizes.update(groups)
            _folds(self.folds, sum(n for n, _ in groups.values()))
            # shuffled places need no key
            return {c: () for c in groups} if self.shuffle else {c: x[1:] for c, x in self.starts(groups).items()}

        try:
            found = order_statistics(rows, rid, ranks, "_c", max_groups=MAX_CLASSES)
        except ValueError as error:
            raise ValidationError(str(error), "stratify by fewer classes") from None
        starts = self.starts(sizes)
        first = sorted(sizes, key=lambda c: sizes[c][1])  # classes are numbered by their first row
        seeds = {c: derive(seed, "stratified-k-fold-class", i) for i, c in enumerate(first)}
        base, total = {}, 0
        for c in sorted(sizes):
            base[c], total = total, total + sizes[c][0]
        # at most MAX_CLASSES rows: safe to broadcast
        table = F.broadcast(data.df.sparkSession.createDataFrame(
            [(c, base[c], starts[c], [x for x in found[c].keys if x is not None], seeds[c]) for c in sizes],
            "_c long, base long, starts array<long>, cuts array<long>, seed long"))
        if not self.shuffle:
            # within its class, every fold begins at an id: no row is moved
            return rows.join(table, "_c").select(rid, F.size(F.filter("cuts", lambda x: x <= F.col(rid))).alias("fold"))
        if self.exact:
            placed = with_dense_index(rows, ["_c", rid]).join(table, "_c").withColumn("idx", F.col("idx") - F.col("base"))
            placed = _shuffled(placed, {c: (sizes[c][0], seeds[c]) for c in sizes}, "_c")
        else:
            key = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(rid).cast("string")))
            keyed = rows.join(table.select("_c", "seed"), "_c").withColumn("_k", key).drop("seed")
            placed = with_dense_index(keyed, ["_c", "_k", rid]).join(table, "_c").withColumn("idx", F.col("idx") - F.col("base"))
        return placed.select(rid, (F.size(F.filter("starts", lambda s: s <= F.col("idx"))) - 1).cast("int").alias("fold"))


@dataclass(frozen=True)
class GroupKFold:
    """Whole groups per fold: by falling size, then falling label, each to the smallest fold.

    Where a group goes depends on the sizes alone, so the driver gets the histogram of sizes: how many
    groups have a size. Groups of one size go round the folds, which makes few runs of a repeated
    pattern however many groups there are; a group finds its run by its place among its size.
    """

    folds: int = 5

    def place(self, sizes: list[tuple[int, int]]) -> dict[int, int]:
        """group -> fold of (group, size) pairs, one by one: the rule itself."""
        heap = [(0, f) for f in range(self.folds)]
        out = {}
        for group, size in sorted(sizes, key=lambda g: (-g[1], -g[0])):
            load, fold = heapq.heappop(heap)
            out[group] = fold
            heapq.heappush(heap, (load + size, fold))
        return out

    def runs(self, histogram: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, list[int]]]]]:
        """For (size, number of groups) pairs by falling size: (size, [(first place, folds in turn)])."""
        load = [0] * self.folds
        out = []
        for size, groups in histogram:
            own: list[tuple[int, list[int]]] = []
            at = 0
            while at < groups:
                order = sorted(range(self.folds), key=lambda f: (load[f], f))
                # folds within one size of the least take turns until they reach the next one
                turn = [f for f in order if load[f] < load[order[0]] + size]
                rounds = (groups - at) // len(turn)
                if len(turn) < self.folds:
                    rounds = min(rounds, max(0, (load[order[len(turn)]] - load[turn[-1]] - 1) // size))
                if not rounds:
                    turn, rounds = turn[:1], 1
                own.append((at, turn))
                for f in turn:
                    load[f] += rounds * size
                at += rounds * len(turn)
            out.append((size, own))
        return out

    def assign(self, data: Dataset, seed: int = 0) -> DataFrame:
        if not data.group:
            raise ValidationError("group folds need groups", "admit the dataset with a group column")
        if self.folds < 2:
            raise ValidationError(f"{self.folds} folds", "use two folds or more")
        spark = data.df.sparkSession
        counts = data.df.groupBy(F.col(f"`{data.group}`").alias("_g")).agg(F.count(F.lit(1)).alias("n"))
        indexed = with_dense_index(counts.withColumns({"_n": -F.col("n"), "_l": -F.col("_g").cast("decimal(20,0)")}), ["_n", "_l"])
        # the sizes that differ are few: with r rows at most the square root of 2 r
        histogram = sorted(((r["n"], r["m"]) for r in indexed.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
        m = sum(c for _, c in histogram)
        if m < self.folds:
            raise ValidationError(f"{self.folds} folds for {m} groups", "use as many folds as groups at most")
        base, rows = 0, []
        for (size, groups), (_, own) in zip(histogram, self.runs(histogram), strict=True):
            rows.append((size, base, [at for at, _ in own], [turn for _, turn in own]))
            base += groups
        table = spark.createDataFrame(rows, "n long, base long, starts array<long>, turns array<array<int>>")
        run = F.size(F.filter("starts", lambda s: s <= F.col("idx") - F.col("base"))) - 1
        placed = (indexed.join(table, "n").withColumns({"_run": run, "_at": F.col("idx") - F.col("base")})
                  .withColumn("_turn", F.get("turns", F.col("_run")))
                  .select("_g", F.get("_turn", ((F.col("_at") - F.get("starts", F.col("_run"))) % F.size("_turn")).cast("int")).alias("fold")))
        return data.df.select(data.row_id, F.col(f"`{data.group}`").alias("_g")).join(placed, "_g").select(data.row_id, "fold")


@dataclass(frozen=True)
class TimeSeriesSplit:
    """Fold f tests the window of ``test_size`` rows before the last k - 1 - f windows, and trains
    on all rows before it but the last ``gap``. Rows are in time order by ``row_id``."""

    folds: int = 5
    test_size: int | None = None
    gap: int = 0

    def windows(self, n: int) -> list[tuple[int, int, int]]:
        """(train stop, test start, test stop) for each fold."""
        if self.folds < 2:
            raise ValidationError(f"{self.folds} folds", "use two folds or more")
        if self.gap < 0:
            raise ValidationError("the gap is negative", "use a gap of 0 or more")
        size = n // (self.folds + 1) if self.test_size is None else self.test_size
        if size < 1 or size > (n - self.gap - 1) // self.folds:
            raise ValidationError(f"{self.folds} windows of {size} rows and a gap of {self.gap} don't fit {n} rows",
                                  "use fewer folds, a smaller window or a smaller gap")
        first = n - self.folds * size
        return [(first + f * size - self.gap, first + f * size, first + (f + 1) * size) for f in range(self.folds)]

    def assign(self, data: Dataset, seed: int = 0, order: str | None = None) -> DataFrame:
        rid = data.row_id
        if order in (None, rid):
            # every window begins and ends at an id: no row is moved
            windows: list[tuple[int, int, int]] = []

            def ranks(groups: dict[int, tuple[int, int]]) -> dict[int, Sequence[int]]:
                windows[:] = self.windows(sum(n for n, _ in groups.values()))
                return {g: [x for w in windows for x in w] for g in groups}

            found = order_statistics(data.df.select(rid), rid, ranks)
            if not found:
                self.windows(0)
            place, rows = F.col(rid), data.df.select(rid)
            top = 1 << 63  # past the last row
            cuts = [top if x is None else x for x in found[0].keys]
            windows = [tuple(cuts[i:i + 3]) for i in range(0, len(cuts), 3)]
        else:
            # rows of equal time are in the order of their ids
            windows = self.windows(data.rows if data.rows is not None else data.df.count())
            rows = with_dense_index(data.df.select(order, rid), [order, rid])
            place = F.col("idx")
        limit = [tuple(F.lit(x if x < 1 << 63 else (1 << 63) - 1).cast("long") for x in w) for w in windows]
        past = [w[2] >= 1 << 63 for w in windows]
        parts = F.array(*[F.struct(F.lit(f).alias("fold"), F.when(place < a, "train").when(
            (place >= b) & (F.lit(True) if last else place < c), "test").alias("part")) for f, ((a, b, c), last) in enumerate(zip(limit, past, strict=True))])
        return rows.select(rid, F.explode(F.filter(parts, lambda p: p["part"].isNotNull())).alias("s")).select(
            rid, "s.fold", "s.part")


@dataclass(frozen=True)
class Split:
    """A train and a test part of one dataset."""

    train: Dataset
    test: Dataset

    def materialize(self) -> Split:
        return Split(self.train.materialize(), self.test.materialize())


def check_split(train: DataFrame, test: DataFrame, source: Dataset) -> None:
    """Both parts non-empty, unique, disjoint and of ``source``; one aggregate."""
    rid = source.row_id
    both = (train.select(rid, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(test.select(rid, F.lit(0).alias("a"), F.lit(1).alias("b")))
            .groupBy(rid).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            .join(source.df.select(rid, F.lit(True).alias("known")), rid, "left"))
    found = both.agg(F.sum("a").alias("train"), F.sum("b").alias("test"), F.count_if(F.col("a") > 1).alias("twice_a"),
                     F.count_if(F.col("b") > 1).alias("twice_b"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"),
                     F.count_if(F.col("known").isNull()).alias("foreign")).first()
    for part in ("train", "test"):
        if not found[part]:
            raise ValidationError(f"the {part} part is empty", "choose fewer folds or another splitter")
    if found["twice_a"] or found["twice_b"]:
        raise ValidationError("a part has a row twice", "give every row once")
    if found["shared"]:
        raise ValidationError(f"{found['shared']} rows are in both parts", "make the parts disjoint")
    if found["foreign"]:
        raise ShapeError("a part has rows that the dataset doesn't have", "split this dataset")


def split_parts(data: Dataset, assigned: DataFrame, folds: list[int] | None = None) -> list[Split]:
    """Lazy train and test datasets of every fold of an assignment. With ``folds`` known, ``assigned``
    is the dataset with its fold columns already."""
    joined = assigned
    if folds is None:
        folds = sorted(r["fold"] for r in assigned.select("fold").distinct().collect())
        joined = data.df.join(assigned, data.row_id)
    timed = "part" in assigned.columns
    out = []
    for f in folds:
        here = F.col("fold") == f
        train = joined.where(here & (F.col("part") == "train") if timed else ~here)
        test = joined.where(here & (F.col("part") == "test") if timed else here)
        out.append(Split(data.with_rows(train.select(*data.roles)), data.with_rows(test.select(*data.roles))))
    return out
