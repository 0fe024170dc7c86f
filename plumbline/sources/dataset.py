"""Datasets: a DataFrame with roles (row id, features, target, weight, group), admitted by one aggregate.

Rows have no position in Spark, so every dataset has an explicit, unique, ordered ``row_id``. Missing
features are NaN; nulls become NaN on admission.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import DataError, ShapeError, ValidationError
from plumbline.functions.numeric import is_finite, is_infinite
from plumbline.schema import FeatureSchema
from plumbline.sources.scratch import materialise

REGRESSION, CLASSIFICATION = "regression", "classification"
REQUIRE_FINITE, ALLOW_NAN = "require_finite", "allow_nan"


def vector(spark: SparkSession, values: Iterable[float], name: str = "value") -> DataFrame:
    """A column of doubles with row ids 0, 1, ..."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"row_id long, {name} double")


def vector_filled(spark: SparkSession, length: int, value: float | Callable[[Any], Any], name: str = "value") -> DataFrame:
    """``length`` equal values, or a function of the row id column; made on the executors."""
    if length < 0:
        raise DataError("negative dimension", f"a vector has no {length} values", name="length", value=length)
    rows = spark.range(length).withColumnRenamed("id", "row_id")
    made = value(F.col("row_id")) if callable(value) else F.lit(float(value))
    return rows.withColumn(name, made.cast("double"))


def matrix(spark: SparkSession, rows: Sequence[Sequence[float]], names: Sequence[str] | None = None) -> DataFrame:
    """One double column per feature with row ids; rows of unequal length are rejected."""
    width = len(rows[0]) if rows else len(names or ())
    for i, row in enumerate(rows):
        if len(row) != width:
            raise DataError("ragged matrix", f"row {i} has {len(row)} values, not {width}", row=i,
                            expected_columns=width, observed_columns=len(row))
    names = list(names) if names else [f"f{k}" for k in range(width)]
    schema = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], schema)


def matrix_init(spark: SparkSession, rows: int, columns: int, make: Callable[[Any, int], Any]) -> DataFrame:
    """A matrix whose column k is ``make(row_id, k)``, made on the executors."""
    for name, n in (("rows", rows), ("columns", columns)):
        if n < 0:
            raise DataError("negative dimension", f"a matrix has no {n} {name}", name=name, value=n)
    base = spark.range(rows).withColumnRenamed("id", "row_id")
    return base.select("row_id", *[make(F.col("row_id"), k).cast("double").alias(f"f{k}") for k in range(columns)])


@dataclass(frozen=True)
class Dataset:
    """An admitted dataset. ``df`` has exactly the role columns; views of it are lazy plans."""

    df: DataFrame
    schema: FeatureSchema
    features: tuple[str, ...]
    target: str
    task: str
    weight: str | None = None
    group: str | None = None
    row_id: str = "row_id"
    finiteness: str = REQUIRE_FINITE
    rows: int | None = None
    access: str = field(default="view")  #: "view" (lazy) or "copy" (persisted)

    @property
    def roles(self) -> list[str]:
        return [self.row_id, *self.features, self.target, *(c for c in (self.weight, self.group) if c)]

    def with_rows(self, df: DataFrame, rows: int | None = None) -> Dataset:
        return replace(self, df=df, rows=rows, access="view")

    # -- access --------------------------------------------------------------------------------
    def row(self, row_id: int) -> dict[str, Any]:
        """One row; bounds are checked by looking."""
        found = self.df.where(F.col(self.row_id) == row_id).take(1)
        if not found:
            raise DataError("index out of bounds", f"no row {row_id}", index=row_id)
        return found[0].asDict()

    def element(self, row_id: int, feature: int) -> float:
        if not 0 <= feature < len(self.features):
            raise DataError("index out of bounds", f"feature {feature}", index=feature, upper_bound=len(self.features))
        return self.row(row_id)[self.features[feature]]

    def collect_features(self) -> list[list[float]]:
        """An export to the driver, in row order; for small datasets."""
        rows = self.df.orderBy(self.row_id).select(*self.features).collect()
        return [list(r) for r in rows]

    # -- views ---------------------------------------------------------------------------------
    def view(self, positions: Sequence[int] | DataFrame) -> DataFrame:
        """Rows by id, in order, duplicates kept: columns ``pos`` and the roles.

        ``positions`` are ids or a DataFrame (pos, row_id). Unknown ids fail when ``positions`` is
        a sequence; a DataFrame is joined lazily.
        """
        spark = self.df.sparkSession
        if isinstance(positions, DataFrame):
            return positions.join(self.df, self.row_id)
        wanted = spark.createDataFrame([(p, int(i)) for p, i in enumerate(positions)], f"pos long, {self.row_id} long")
        found = wanted.join(self.df, self.row_id, "left")
        missing = wanted.join(self.df.select(self.row_id), self.row_id, "left_anti").agg(F.min(self.row_id)).first()[0]
        if missing is not None:
            raise DataError("index out of bounds", f"no row {missing}", index=missing)
        return found.orderBy("pos")

    def where(self, condition: Any) -> Dataset:
        """A lazy row subset."""
        return self.with_rows(self.df.where(condition))

    def materialize(self) -> Dataset:
        """The rows checked again (weights of a subset may all be zero) and persisted."""
        kept = replace(self, df=self.df.persist(), access="copy")
        return replace(kept, rows=validate(kept)["rows"])

    def select_features(self, indices: Sequence[int]) -> Dataset:
        names = tuple(self.features[i] for i in indices)
        schema = self.schema.subset(indices)
        out = replace(self, features=names, schema=schema)
        return replace(out, df=self.df.select(*out.roles))

    def group_counts(self) -> DataFrame:
        """(group, n): the rows of every group."""
        if not self.group:
            raise ValidationError("the dataset has no groups", "name a group column on admission")
        return self.df.groupBy(F.col(f"`{self.group}`").alias("group")).agg(F.count(F.lit(1)).alias("n"))

    def distinct_groups(self) -> int:
        return self.group_counts().count()


def admit(df: DataFrame, features: Sequence[str], target: str, task: str = REGRESSION, row_id: str = "row_id",
          weight: str | None = None, group: str | None = None, finiteness: str = REQUIRE_FINITE,
          names: Sequence[str] | None = (), check: bool = True, unique_ids: bool = False) -> Dataset:
    """Validate and project. ``names`` () takes the column names, None makes an anonymous schema.

    One aggregate checks features, then target, weights and groups, in that order; the first bad
    row (by row id) is reported. A second one, which shuffles the ids, checks that they are unique;
    ``unique_ids`` True skips it where the source's key says so. ``check`` False leaves the plan
    lazy, for data admitted before.
    """
    if task not in (REGRESSION, CLASSIFICATION):
        raise ValidationError(f"unknown task {task!r}", f"use {REGRESSION!r} or {CLASSIFICATION!r}")
    if finiteness not in (REQUIRE_FINITE, ALLOW_NAN):
        raise ValidationError(f"unknown finiteness policy {finiteness!r}", f"use {REQUIRE_FINITE!r} or {ALLOW_NAN!r}")
    features = tuple(features)
    for c in (row_id, *features, target, weight, group):
        if c is not None and c not in df.columns:
            raise ShapeError(f"no column {c!r}", "pass a DataFrame with all role columns", name=c)
    schema = FeatureSchema.anonymous(len(features)) if names is None else FeatureSchema.named(names or features)
    if schema.width != len(features):
        raise DataError("length mismatch", f"{schema.width} names for {len(features)} features",
                        expected=len(features), observed=schema.width)
    nan = F.lit(float("nan"))
    columns = [F.col(f"`{row_id}`").cast("long").alias(row_id),
               *(F.coalesce(F.col(f"`{c}`").cast("double"), nan).alias(c) for c in features),
               (F.coalesce(F.col(f"`{target}`").cast("double"), nan) if task == REGRESSION
                else F.col(f"`{target}`").cast("long")).alias(target)]
    if weight:
        columns.append(F.coalesce(F.col(f"`{weight}`").cast("double"), nan).alias(weight))
    if group:
        columns.append(F.col(f"`{group}`").cast("long").alias(group))
    data = Dataset(df.select(*columns), schema, features, target, task, weight, group, row_id, finiteness)
    if not check:
        return data
    data = replace(data, rows=validate(data)["rows"])
    if not unique_ids:
        require_unique_ids(data)
    return data


def repeated_ids(data: Dataset) -> DataFrame:
    """(row_id, n) of the ids that more than one row has."""
    rid = F.col(f"`{data.row_id}`")
    return data.df.groupBy(rid.alias("row_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique_ids(data: Dataset) -> None:
    """Fail at the least row id that more than one row has; else a join on ids would multiply rows."""
    found = repeated_ids(data).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("row_id", "n")).alias("first")).first()
    if found["m"]:
        raise ValidationError(f"{found['first']['n']} rows have the id {found['first']['row_id']}", "give every row a unique id")


def admission_report(data: Dataset) -> DataFrame:
    """One row: counts of rows, missing and infinite cells, bad targets, weights and row ids."""
    df = data.df
    cells = [F.col(f"`{c}`") for c in data.features]
    total = F.lit(0).cast("long")
    missing = infinite = total
    for c in cells:
        missing = missing + F.isnan(c).cast("long")
        infinite = infinite + F.coalesce(is_infinite(c), F.lit(False)).cast("long")
    target = F.col(f"`{data.target}`")
    bad_target = ~is_finite(target) if data.task == REGRESSION else target.isNull()
    weight = F.col(f"`{data.weight}`") if data.weight else F.lit(1.0)
    return df.select(missing.alias("m"), infinite.alias("i"), bad_target.cast("long").alias("t"), weight.alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("infinite_cells"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("bad_targets"),
        F.coalesce(F.sum(F.when(~is_finite(F.col("w")), 1).otherwise(0)), F.lit(0)).alias("bad_weights"),
        F.coalesce(F.sum(F.when(F.col("w") < 0, 1).otherwise(0)), F.lit(0)).alias("negative_weights"),
        F.coalesce(F.sum(F.when(F.col("w") > 0, 1).otherwise(0)), F.lit(0)).alias("positive_weights"))


def validate(data: Dataset) -> dict[str, Any]:
    """Run the admission aggregate; raise the first failure."""
    df, rid = data.df, F.col(f"`{data.row_id}`")
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count_if(rid.isNull()).alias("no_id")]
    for k, c in enumerate(data.features):
        cell = F.col(f"`{c}`")
        bad = is_infinite(cell) if data.finiteness == ALLOW_NAN else ~is_finite(cell)
        aggregates.append(F.min(F.when(bad, F.struct(rid.alias("r"), F.lit(k).alias("k"), cell.alias("v")))).alias(f"_f{k}"))
    target = F.col(f"`{data.target}`")
    bad_target = ~is_finite(target) if data.task == REGRESSION else target.isNull()
    aggregates.append(F.min(F.when(bad_target, rid)).alias("_y"))
    if data.weight:
        w = F.col(f"`{data.weight}`")
        aggregates += [F.min(F.when(~is_finite(w), rid)).alias("_w"),
                       F.min(F.when(w < 0, F.struct(rid.alias("r"), w.alias("v")))).alias("_neg"),
                       F.count_if(w > 0).alias("_pos")]
    if data.group:
        aggregates.append(F.min(F.when(F.col(f"`{data.group}`").isNull(), rid)).alias("_g"))
    found = df.agg(*aggregates).first().asDict()
    if found["no_id"]:
        raise ValidationError("row ids are null", "give every row a unique id")
    cells = [found[f"_f{k}"] for k in range(len(data.features)) if found[f"_f{k}"] is not None]
    if cells:
        row, k, value = min(cells, key=lambda c: (c["r"], c["k"]))
        raise DataError("non-finite", f"feature {data.features[k]!r} of row {row} is {value}",
                        "impute missing values or allow NaN", row=row, column=k,
                        index=row * len(data.features) + k, value=value)
    if found["_y"] is not None:
        raise DataError("non-finite", f"the target of row {found['_y']} is missing or not finite", index=found["_y"])
    if data.weight:
        if found["_w"] is not None:
            raise DataError("non-finite", f"the weight of row {found['_w']} is not finite", index=found["_w"])
        if found["_neg"] is not None:
            raise DataError("negative weight", f"weight {found['_neg']['v']} of row {found['_neg']['r']}",
                            index=found["_neg"]["r"], value=found["_neg"]["v"])
        if not found["_pos"]:
            raise DataError("all-zero weights", "no weight is positive", "give at least one row a positive weight")
    if data.group and found["_g"] is not None:
        raise DataError("length mismatch", f"row {found['_g']} has no group", index=found["_g"])
    return found


def with_dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """A dense 0-based index in the given order without a single-task window.

    Rows are range-partitioned, sorted and numbered inside their partition, and written with that
    number, since drawing the ranges again might deal rows otherwise; then each row adds the offset
    of its partition. One shuffle; only the counts (one per partition) meet the driver.
    """
    ranged = materialise(range_numbered(df, [F.col(c) for c in order]), "ordered")
    return ranged.withColumn(name, F.col("_at").bitwiseAND(F.lit(_PLACE)) + offsets(ranged)).drop("_at")


#: ``monotonically_increasing_id`` has the partition above these bits.
_PART_BITS = 33
_PLACE = (1 << _PART_BITS) - 1


def range_numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions by ``order``, sorted, with ``_at``: partition and place in it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def part_of() -> Column:
    """The range partition of a numbered row."""
    return F.shiftright("_at", _PART_BITS)


def offsets(ranged: DataFrame) -> Column:
    """The number of rows in the partitions before a row's own."""
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part_of().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    return F.get(F.array(*[F.lit(o).cast("long") for o in before or [0]]), part_of().cast("int"))
