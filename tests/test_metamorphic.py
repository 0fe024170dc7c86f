"""What must not change a result: the order and partitions of rows, repeats that weights make up for, shifts, names of
labels. And code from outside the library behind its interfaces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import protocols
from plumbline.errors import ValidationError
from plumbline.functions import numeric
from plumbline.functions.order import order_statistics
from plumbline.functions.seeds import Rng, derive, permutation
from plumbline.operators import metrics as M
from plumbline.operators.linalg import Factor, pivoted_solve, tsqr
from plumbline.operators.linear import LinearRegression, LogisticRegression, RidgeRegression, discover_classes
from plumbline.operators.preprocess import SimpleImputer, StandardScaler, VarianceThreshold, exact_medians
from plumbline.operators.splitters import GroupKFold, KFold, StratifiedKFold, TimeSeriesSplit
from plumbline.plans.execution import BoundedPool, Sequential
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.selection import cross_validate
from plumbline.schema import FeatureSchema
from plumbline.sources.dataset import CLASSIFICATION, admit, with_dense_index

NAMES = ["a", "b"]
SCHEMA = FeatureSchema.named(NAMES)


def frame(spark, n=50, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1.5 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n)
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 0.2), 1.0 + i % 3, i // 7) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y double, label long, w double, grp long")


def shuffled(df, partitions):
    return df.repartition(partitions, F.xxhash64("row_id")).orderBy(F.xxhash64("row_id")).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_in_any_order(spark, partitions):
    df, other = frame(spark), shuffled(frame(spark), partitions)
    for spec in (SimpleImputer("median"), StandardScaler(), VarianceThreshold(0.1)):
        assert repr(spec.fit(df, NAMES, SCHEMA))[:60] == repr(spec.fit(other, NAMES, SCHEMA))[:60]
    a, b = (RidgeRegression(0.5).fit(d, NAMES, "y", SCHEMA, "w") for d in (df, other))
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-9) and a.intercept == pytest.approx(b.intercept, rel=1e-9)
    a, b = (LogisticRegression().fit(d, NAMES, "label", SCHEMA, "w") for d in (df, other))
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-7)
    for splitter in (KFold(4), KFold(4, True), KFold(4, True, True), StratifiedKFold(3, True), StratifiedKFold(3, True, True), GroupKFold(3),
                     TimeSeriesSplit(3)):
        first, second = ({tuple(r) for r in splitter.assign(admit(d, NAMES, "label", CLASSIFICATION, group="grp"), 5).collect()} for d in (df, other))
        assert first == second


def test_target_translation(spark):
    df = frame(spark)
    a = LinearRegression().fit(df, NAMES, "y", SCHEMA)
    b = LinearRegression().fit(df.withColumn("y", F.col("y") + 1000), NAMES, "y", SCHEMA)
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-9) and b.intercept == pytest.approx(a.intercept + 1000, rel=1e-9)
    far = LinearRegression().fit(df.withColumn("a", F.col("a") + 1e7), NAMES, "y", SCHEMA)
    assert far.coefficients == pytest.approx(a.coefficients, rel=1e-6) and far.report.rank == 2


def test_repeated_rows_equal_weights(spark):
    df = frame(spark)
    times = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    for model, target in ((RidgeRegression(0.7), "y"), (LinearRegression(), "y"), (LogisticRegression(), "label")):
        a, b = model.fit(df, NAMES, target, SCHEMA, "w"), model.fit(times, NAMES, target, SCHEMA)
        assert a.coefficients == pytest.approx(b.coefficients, rel=1e-6) and a.intercept == pytest.approx(b.intercept, rel=1e-6)
    scored = df.select(F.col("label").alias("truth"), (F.col("a") > 0).cast("long").alias("pred"), (1 / (1 + F.exp(-F.col("a")))).alias("p"), "w")
    again = scored.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    for metric in (M.accuracy, M.f1, M.log_loss, M.roc_auc):
        assert metric(scored, weight="w") == pytest.approx(metric(again), rel=1e-9)


def test_label_renaming(spark):
    df = frame(spark)
    a = LogisticRegression().fit(df, NAMES, "label", SCHEMA)
    b = LogisticRegression().fit(df.withColumn("label", F.when(F.col("label") == 1, 40).otherwise(-3)), NAMES, "label", SCHEMA)
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-12) and b.classes == (-3, 40)
    assert discover_classes(df, "label", "w") == (0, 1)
    data = admit(df, NAMES, "label", CLASSIFICATION)
    other = admit(df.withColumn("label", 10 - F.col("label")), NAMES, "label", CLASSIFICATION)
    for splitter in (StratifiedKFold(3), StratifiedKFold(3, True), StratifiedKFold(3, True, True)):
        assert {tuple(r) for r in splitter.assign(data, 1).collect()} == {tuple(r) for r in splitter.assign(other, 1).collect()}


def test_exact_stratified_shuffle_follows_the_generator(spark):
    labels = [0, 1, 1, 0, 2, 1, 0, 1, 2, 0, 1, 1, 2]
    df = spark.createDataFrame([(i, 0.0, c) for i, c in enumerate(labels)], "row_id long, x double, label long").repartition(3)
    found = {r["row_id"]: r["fold"] for r in StratifiedKFold(3, True, True).assign(admit(df, ["x"], "label", CLASSIFICATION), 9).collect()}
    expected, offset = {}, 0
    for number, c in enumerate((0, 1, 2)):  # by first appearance
        rows = [i for i, x in enumerate(labels) if x == c]
        order = [rows[k] for k in permutation(len(rows), derive(9, "stratified-k-fold-class", number))]
        sizes = [sum((offset + p) % 3 == f for p in range(len(rows))) for f in range(3)]
        at = 0
        for f, n in enumerate(sizes):
            expected |= {i: f for i in order[at:at + n]}
            at += n
        offset += len(rows)
    assert found == expected


def test_runs_equal_one_by_one_placement():
    rng = random.Random(3)
    for _ in range(400):
        g = GroupKFold(rng.randint(2, 7))
        top = rng.choice([1, 2, 5, 40, 300])
        sizes = [(i, rng.randint(1, top if rng.random() < 0.8 else 20 * top)) for i in range(rng.randint(1, 60))]
        expected = g.place(sizes)
        histogram = sorted({s: sum(x == s for _, x in sizes) for _, s in sizes}.items(), reverse=True)
        runs = dict(g.runs(histogram))
        for size, _ in histogram:
            for place, group in enumerate(sorted((i for i, x in sizes if x == size), reverse=True)):
                start, turn = [r for r in runs[size] if r[0] <= place][-1]
                assert turn[(place - start) % len(turn)] == expected[group]
    assert sum(len(own) for _, own in GroupKFold(4).runs([(10**9, 1), (1, 10**9)])) < 10


# -- exactness -------------------------------------------------------------------------------------
def test_exact_sums_equal_fsum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000) * 10.0 ** rng.integers(-300, 300, 4000)
    y = np.r_[rng.normal(size=2000) * 1e16, 5e-324, 1.0, -0.0, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(float(a), float(b), math.nan if i == 3 else 1.0, math.inf) for i, (a, b) in enumerate(zip(x, np.resize(y, 4000), strict=True))],
                               "x double, y double, bad double, up double").repartition(5)
    found = numeric.exact_column_sums(df, ["x", "y", "bad", "up"])
    assert found[:2] == [math.fsum(x), math.fsum(np.resize(y, 4000))] and math.isnan(found[2]) and found[3] == math.inf
    both = spark.createDataFrame([(math.inf,), (-math.inf,), (None,)], "x double")
    assert math.isnan(numeric.exact_column_sums(both, ["x"])[0]) and numeric.exact_column_sums(both.limit(0), ["x"]) == [0.0]
    assert numeric.dot_columns(spark.createDataFrame([(1e8, 1e8), (1.0, 1.0), (-1e8, 1e8)], "a double, b double"), "a", "b") == 1.0


def test_row_products(spark):
    df = spark.createDataFrame([(1e16, 1.0, -1e16), (math.inf, 1.0, 2.0), (math.inf, 1.0, -math.inf)], "a double, b double, c double")
    found = [r[0] for r in numeric.matrix_vector(df, ["a", "b", "c"], [1.0, 1.0, 1.0]).select("product").collect()]
    assert found[0] == 1.0 and found[1] == math.inf and math.isnan(found[2])
    wide = spark.range(3).select(*[(F.col("id") + k).cast("double").alias(f"x{k}") for k in range(600)])
    made = wide.select(numeric.linear(wide.columns, [0.5] * 600, 2.0).alias("z"))
    assert [r[0] for r in made.collect()] == [2.0 + 0.5 * sum(i + k for k in range(600)) for i in range(3)]


@pytest.mark.parametrize("most", [500_000, 10, 1])
def test_medians_equal_numpy(spark, most):
    rng = np.random.default_rng(4)
    columns = {"even": rng.normal(size=400), "ties": rng.integers(0, 4, 400).astype(float), "one": np.full(400, 7.0),
               "skew": 10.0 ** rng.normal(size=400), "holes": np.where(rng.random(400) < 0.4, np.nan, rng.normal(size=400)), "none": np.full(400, np.nan)}
    df = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) for i in range(400)], ", ".join(f"{c} double" for c in columns)).repartition(3)
    found = exact_medians(df, list(columns), most)
    assert [v for v, _ in found[:-1]] == [float(np.nanmedian(c)) for c in list(columns.values())[:-1]] and found[-1] == (None, False)
    assert exact_medians(df.withColumn("even", F.lit(math.inf)), ["even"], most)[0] == (None, True)


@pytest.mark.parametrize("most", [500_000, 40, 1])
def test_order_statistics_equal_sorting(spark, most):
    rng = np.random.default_rng(6)
    keys = {0: rng.choice(10**12, 700, replace=False), 1: np.arange(50, 250), 2: rng.choice(40, 20, replace=False) * 7, 5: np.array([3])}
    rows = [(g, int(x)) for g, own in keys.items() for x in own]
    df = spark.createDataFrame(rows, "g long, x long").repartition(4)
    ranks = {g: sorted({0, len(own) - 1, len(own) // 2, len(own) // 3, len(own) + 2, int(rng.integers(0, len(own)))}) for g, own in keys.items()}
    found = order_statistics(df, "x", lambda groups: ranks, "g", most)
    for g, own in keys.items():
        assert found[g].rows == len(own) and found[g].least == min(own)
        assert list(found[g].keys) == [int(np.sort(own)[r]) if r < len(own) else None for r in ranks[g]]
    assert order_statistics(df.limit(0), "x", lambda groups: {}) == {}
    with pytest.raises(ValueError):
        order_statistics(df, "x", lambda groups: ranks, "g", max_groups=3)


def test_folds_of_sparse_ids(spark):
    rng = np.random.default_rng(8)
    ids = np.sort(rng.choice(10**9, 203, replace=False)).tolist()
    df = spark.createDataFrame([(int(i), 0.0, int(rng.integers(0, 3))) for i in ids], "row_id long, x double, label long").repartition(5)
    data = admit(df, ["x"], "label", CLASSIFICATION)
    folds = {r["row_id"]: r["fold"] for r in KFold(4).assign(data).collect()}
    assert [folds[i] for i in ids] == [0] * 51 + [1] * 51 + [2] * 51 + [3] * 50
    timed = TimeSeriesSplit(3, gap=2).assign(data).collect()
    for f, (stop, start, end) in enumerate(TimeSeriesSplit(3, gap=2).windows(203)):
        assert sorted(r["row_id"] for r in timed if (r["fold"], r["part"]) == (f, "train")) == ids[:stop]
        assert sorted(r["row_id"] for r in timed if (r["fold"], r["part"]) == (f, "test")) == ids[start:end]
    by_time = TimeSeriesSplit(3, gap=2).assign(data, order="x").collect()
    assert {tuple(r) for r in by_time} == {tuple(r) for r in timed}


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "id long, k long").repartition(5)
    found = with_dense_index(df, ["k", "id"]).orderBy("idx").collect()
    assert [r["idx"] for r in found] == list(range(101)) and [(r["k"], r["id"]) for r in found] == sorted((r["k"], r["id"]) for r in found)
    assert with_dense_index(df.limit(0), ["id"]).count() == 0


def test_factors_know_their_rows(spark):
    df = frame(spark)
    found = tsqr(df.repartition(3), [F.sqrt("w"), F.col("a")], by="label")
    assert sum(f.rows for f in found.values()) == 50 and max(f.top for f in found.values()) == pytest.approx(math.sqrt(3))
    whole = Factor.empty(2)
    whole.add(np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert whole.rows == 2 and np.allclose(whole.r.T @ whole.r, [[10, 14], [14, 20]])


def test_line_search_shortens_the_step(spark, monkeypatch):
    """A curvature that is far too small makes the whole step overshoot; halving finds the optimum all the same."""
    df = frame(spark, 80)
    right = LogisticRegression().fit(df, NAMES, "label", SCHEMA)
    called = []
    import plumbline.operators.linear as L
    real = L.pivoted_solve
    monkeypatch.setattr(L, "pivoted_solve", lambda a, b, rows=None: (lambda x: (x[0] * 6, x[1]))(real(a, b, rows)))
    shorter = LogisticRegression._shorter
    monkeypatch.setattr(LogisticRegression, "_shorter", lambda self, *a: called.append(1) or shorter(self, *a))
    found = LogisticRegression(tolerance=1e-6).fit(df, NAMES, "label", SCHEMA)
    assert called and found.coefficients == pytest.approx(right.coefficients, rel=1e-3)


# -- admission and predictions ---------------------------------------------------------------------
def test_row_ids_are_unique(spark):
    df = frame(spark, 10)
    with pytest.raises(ValidationError, match="2 rows have the id 3"):
        admit(df.union(df.where("row_id in (3, 5)")), NAMES, "y")
    assert admit(df.union(df.where("row_id = 3")), NAMES, "y", unique_ids=True).rows == 11


def test_prediction_holder(spark):
    df = frame(spark).select(F.col("label"), (F.col("a") > 0).cast("long").alias("guess"), (1 / (1 + F.exp(-F.col("a")))).alias("p"), "w")
    both = M.BinaryPredictions(df, "label", "guess", "p", "w")
    assert set(both.scores()) == set(M.binary_scorers())
    assert set(M.BinaryPredictions(df, "label", probabilities="p").scores()) == {"neg_log_loss", "roc_auc"}
    assert both.scores()["accuracy"] == M.accuracy(df, "label", "guess", "w")
    with pytest.raises(ValidationError):
        M.BinaryPredictions(df, "label")
    with pytest.raises(ValidationError):
        M.BinaryPredictions(df, "label", "nothing")
    with pytest.raises(ValidationError):
        M.BinaryPredictions(df, "label", "guess").score(M.binary_scorers()["roc_auc"])


# -- interfaces ------------------------------------------------------------------------------------
def test_own_classes_conform(spark):
    assert isinstance(KFold(), protocols.Splitter) and isinstance(M.regression_scorers()["r2"], protocols.Scorer)
    assert isinstance(StandardScaler(), protocols.Transformer) and isinstance(LinearRegression(), protocols.Estimator)
    assert isinstance(StandardScaler(), protocols.Specification) and StandardScaler() == StandardScaler()
    assert isinstance(Sequential(), protocols.Execution) and isinstance(BoundedPool(2, 1), protocols.Execution)
    assert isinstance(Rng(1), protocols.Generator) and isinstance(protocols.DefaultBackend(), protocols.NumericalBackend)
    df = frame(spark)
    assert isinstance(LinearRegression().fit(df, NAMES, "y", SCHEMA), protocols.Regressor)
    assert isinstance(LogisticRegression().fit(df, NAMES, "label", SCHEMA), protocols.Classifier)
    assert isinstance(StandardScaler().fit(df, NAMES, SCHEMA), protocols.FittedTransformer)


def test_backend_conformance():
    assert protocols.conforms(protocols.DefaultBackend()) == []

    class Plain:
        sum = staticmethod(lambda v: float(np.r_[0.0, v].cumsum()[-1]))
        dot = staticmethod(lambda a, b: float(np.dot(a, b)))
        solve = staticmethod(lambda a, b: pivoted_solve(a, b))
    assert "sum of [1e+16, 1.0, -1e+16]" in protocols.conforms(Plain())


def test_foreign_components(spark):
    """A transformer, an estimator, a splitter and a scorer that know nothing of the library's classes."""

    class Half:
        def fit(self, df, columns, schema, weight=None, seed=0):
            return FittedHalf(schema)

    class FittedHalf:
        def __init__(self, schema):
            self.schema = self.output_schema = schema

        def transform(self, df, columns, schema, validate=False):
            return df.withColumns({c: F.col(c) / 2 for c in columns}), list(columns)

        def expressions(self, inputs):
            return [x / 2 for x in inputs]

    class Mean:
        task = "regression"

        def fit(self, df, columns, target, schema, weight=None, seed=0):
            return FittedMean(df.agg(F.avg(target)).first()[0])

    class FittedMean:
        def __init__(self, value):
            self.value = value

        def predict(self, df, columns, schema, name="prediction", validate=False):
            return df.withColumn(name, F.lit(self.value))

        def prediction(self, inputs):
            return F.lit(self.value)

    class Odd:
        def assign(self, data, seed=0):
            return data.df.select(data.row_id, (F.col(data.row_id) % 2).cast("int").alias("fold"))

    class Worst:
        name, needs, positive = "worst", "value", None

        def __call__(self, df, weight=None):
            return -df.agg(F.max(F.abs(F.col("pred") - F.col("truth")))).first()[0]

    df = frame(spark)
    data = admit(df, NAMES, "y")
    cv = cross_validate(Pipeline().add("half", Half()).set_estimator("mean", Mean()), data, Odd(), [Worst()])
    y = {r["row_id"]: r["y"] for r in df.collect()}
    for f in cv.folds:
        mean = np.mean([v for i, v in y.items() if i % 2 != f.fold])
        assert f.test_scores["worst"] == pytest.approx(-max(abs(v - mean) for i, v in y.items() if i % 2 == f.fold))


def test_entry_tells_absence_from_damage(monkeypatch):
    import __spark_entry__ as entry
    assert entry._optional("plumbline.nothing", "plumbline.other") is None

    def broken(name):
        raise ModuleNotFoundError("no module", name="zstandard")
    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("plumbline.llm.queries", "plumbline.llm")
