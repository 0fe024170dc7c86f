"""Helpers shared by the training-data operators: tables, materialisation, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialise, release, release_since, written

__all__ = ["batches", "components", "fewer", "forest", "joined_splits", "materialise", "materialise_alone", "numbered", "release", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table with Spark's reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def joined_splits(scan: DataFrame, together: int = 2) -> DataFrame:
    """``scan``, a table as read, with up to ``together`` splits in one task, but at least three tasks for each core."""
    n = scan.rdd.getNumPartitions()
    return scan.coalesce(max(1, n // together, min(n, 3 * scan.sparkSession.sparkContext.defaultParallelism)))


def materialise_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The materialised result of ``make``; what it materialised on the way is deleted."""
    before = written()
    out = materialise(make(), name)
    release_since(before, out)
    return out


def fewer(df: DataFrame) -> DataFrame:
    """``df``, which comes out of a shuffle, in a quarter of its partitions, but in one for each core at least."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that no name of its own can clash with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def batches(frames: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, which bounds what one step holds in memory. At the end the worker,
    which Spark keeps for other tasks, returns the memory that it doesn't use any more."""
    for batch in frames:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label every node of the edges (a, b) with the smallest node of its component.

    Works on one task's edges only; vectorised hooking and pointer jumping.
    Returns (nodes, labels), nodes ascending.
    """
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        low = np.minimum(lx, ly)
        new = label.copy()
        np.minimum.at(new, lx, low)
        np.minimum.at(new, ly, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one task by stars to each local component's smallest node."""
    nodes = labels = np.zeros(0, np.int64)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    for batch in frames:
        a = np.concatenate([nodes, batch.column(0).to_numpy()])
        b = np.concatenate([labels, batch.column(1).to_numpy()])
        if len(a):
            nodes, labels = forest(a, b)
    moved = nodes != labels
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[moved], pa.int64()), pa.array(labels[moved], pa.int64())], schema=schema)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst longs): rows (node, component), component
    the smallest node. Isolated nodes are not listed.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each task first
    contracts its own edges to a star forest, so hubs shrink before any shuffle; the least
    neighbours are kept tables, so a hub's rows in the joins can be split. Every
    round is written to the shared folder. An empty edge table gives an empty result.
    """
    current = materialise(
        edges.select("src", "dst").where("src <> dst").mapInArrow(_contract, "src long, dst long").distinct(),
        "edges")
    for _ in range(limit):
        both = current.union(current.select(F.col("dst"), F.col("src"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).persist()
        # large star: neighbours above u point to the least node around u
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
                 .where("src <> dst").distinct().persist())
        # small star: u and its smaller neighbours point to the least of them
        down = large.groupBy("src").agg(F.min("dst").alias("m")).persist()
        small = (large.join(down, "src")
                 .select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("m").alias("dst")),
                                           F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
                 .select("e.src", "e.dst").where("src <> dst").distinct())
        following = materialise(small, "edges")
        for kept in (least, large, down):
            kept.unpersist()
        release(current)
        # stable once every node has one parent and no parent has a parent
        state = following.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("s")).first()
        chained = following.join(following.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        current = following
        if state["n"] == state["s"] and chained.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {limit} rounds")
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
