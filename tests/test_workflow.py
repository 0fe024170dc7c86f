import math
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.errors import (ArtifactError, CompatibilityError, DataError, SchemaError, ShapeError, ValidationError,
                              WorkflowError)
from plumbline.functions.numeric import compensated_sum, dot, exact_column_sums
from plumbline.operators.linear import LinearRegression, LogisticRegression, RidgeRegression
from plumbline.operators.metrics import binary_scorers, regression_scorers
from plumbline.operators.preprocess import SimpleImputer, StandardScaler, VarianceThreshold
from plumbline.operators.splitters import KFold
from plumbline.plans.execution import BoundedPool, Sequential, diagnose
from plumbline.plans.fusion import ridge_grid
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.selection import RECORD, competition_ranks, cross_validate, grid, search
from plumbline.schema import FeatureSchema
from plumbline.sources import artifact
from plumbline.sources.dataset import ALLOW_NAN, CLASSIFICATION, admit, matrix, matrix_init, vector, vector_filled
from plumbline.streaming.apply import predict_stream, read_features

NAN = math.nan
MSE = regression_scorers()["neg_mean_squared_error"]


def rows(spark, n=60, missing=True):
    return [(i, NAN if missing and i % 7 == 3 else float(i % 5), float(i % 11), 2.0 * (i % 5) - 0.5 * (i % 11) + (i * 37 % 13) / 10,
             1.0 + i % 3, int(i % 5 > 1), i // 6) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(spark), "row_id long, a double, b double, y double, w double, label long, grp long").repartition(3)


@pytest.fixture(scope="module")
def data(frame):
    return admit(frame, ["a", "b"], "y", weight="w", group="grp", finiteness=ALLOW_NAN)


def pipe(estimator=LinearRegression()):
    return Pipeline().add("impute", SimpleImputer()).add("scale", StandardScaler()).set_estimator("model", estimator)


# -- data ------------------------------------------------------------------------------------------
def test_admission(frame, data):
    assert data.rows == 60 and data.distinct_groups() == 10 and data.schema.names == ("a", "b")
    with pytest.raises(DataError) as error:
        admit(frame, ["a", "b"], "y")
    assert error.value.reason == "non-finite" and error.value.details["row"] == 3
    with pytest.raises(DataError) as error:
        admit(frame.withColumn("w", F.lit(0.0)), ["b"], "y", weight="w")
    assert error.value.reason == "all-zero weights"
    with pytest.raises(DataError) as error:
        admit(frame.withColumn("w", F.lit(-1.0)), ["b"], "y", weight="w")
    assert error.value.reason == "negative weight"
    with pytest.raises(DataError):
        admit(frame.withColumn("y", F.lit(math.inf)), ["b"], "y")
    with pytest.raises(DataError):
        admit(frame, ["b"], "y", names=["p", "q"])
    with pytest.raises(ShapeError):
        admit(frame, ["nope"], "y")


def test_views(data):
    seen = data.view([5, 2, 5]).select("row_id").collect()
    assert [r[0] for r in seen] == [5, 2, 5]
    with pytest.raises(DataError):
        data.view([999])
    assert data.element(2, 1) == 2.0
    with pytest.raises(DataError):
        data.element(2, 9)
    with pytest.raises(DataError):
        data.row(999)
    assert data.select_features([1]).schema.names == ("b",)


def test_constructors(spark):
    assert vector(spark, [1, 2]).count() == 2 and vector_filled(spark, 3, 1.5).agg(F.sum("value")).first()[0] == 4.5
    assert matrix_init(spark, 3, 2, lambda r, k: r * 10 + k).where("row_id = 2").first()[1:] == (20.0, 21.0)
    with pytest.raises(DataError):
        vector_filled(spark, -1, 0.0)
    with pytest.raises(DataError):
        matrix(spark, [[1, 2], [3]])


def test_schema():
    s = FeatureSchema.named(["height", "weight"])
    assert s.fingerprint() == FeatureSchema.named(["height", "weight"]).fingerprint() != FeatureSchema.anonymous(2).fingerprint()
    assert s != FeatureSchema.anonymous(2) and s.subset([1]).names == ("weight",)
    for names in (["a", "a"], ["a", ""]):
        with pytest.raises(DataError):
            FeatureSchema.named(names)


def test_sums(spark):
    assert compensated_sum([1e16, 1, -1e16]) == 1.0
    assert math.isnan(compensated_sum([math.inf, -math.inf])) and compensated_sum([math.inf, 1.0]) == math.inf
    assert dot([1e8, 1, -1e8], [1e8, 1, 1e8]) == 1.0
    d = spark.createDataFrame([(1e16,), (1.0,), (-1e16,)], "x double").repartition(2)
    assert exact_column_sums(d, ["x"]) == [1.0]


# -- pipelines -------------------------------------------------------------------------------------
def test_pipeline(data):
    model = pipe().fit(data, 1)
    out = model.predict(data.df, data.features, data.schema, validate=True)
    assert out.count() == 60 and out.agg(F.count_if(F.isnan("prediction"))).first()[0] == 0
    with pytest.raises(SchemaError):
        model.predict(data.df, data.features, FeatureSchema.anonymous(2))
    with pytest.raises(CompatibilityError):
        model.predict_proba(data.df, data.features, data.schema)
    with pytest.raises(ValidationError):
        Pipeline().add("x", SimpleImputer()).add("x", SimpleImputer())
    with pytest.raises(ValidationError):
        Pipeline().add(" ", SimpleImputer())
    with pytest.raises(ValidationError):
        Pipeline().fit(data)
    with pytest.raises(CompatibilityError):
        pipe(LogisticRegression()).fit(data)
    with pytest.raises(ValidationError) as error:
        Pipeline().add("none", VarianceThreshold(1e9)).set_estimator("m", LinearRegression()).fit(data.select_features([1]))
    assert error.value.context == (("stage", "none"),)


def test_pipeline_learns_from_training_rows_only(data):
    part = data.where("row_id < 30")
    model = pipe().fit(part)
    assert model.stages[0][1].values == SimpleImputer().fit(part.df, part.features, part.schema).values


def test_pipeline_applies_by_projection_only(data):
    model = pipe().fit(data)
    base, plan = (df._jdf.queryExecution().executedPlan().toString()
                  for df in (data.df, model.predict(data.df, data.features, data.schema)))
    assert all(plan.count(x) == base.count(x) for x in ("Exchange", "Join", "Aggregate", "Python", "Arrow"))


# -- selection -------------------------------------------------------------------------------------
def test_cross_validation(data):
    cv = cross_validate(pipe(), data, KFold(3), [MSE, regression_scorers()["r2"]], 5, return_train_score=True, return_indices=True,
                        return_models=True)
    assert cv.successful == 3 and len(cv.scores("r2")) == 3
    assert sorted(sum((f.test_rows for f in cv.folds), [])) == list(range(60))
    assert all(f.train_scores["r2"] > 0.5 and f.model for f in cv.folds)
    pooled = cross_validate(pipe(), data, KFold(3), [MSE], 5, execution=BoundedPool(3, 1))
    assert pooled.scores(MSE.name) == pytest.approx(cv.scores(MSE.name), rel=1e-12)


def test_failure_policies(spark):
    tiny = spark.createDataFrame([(i, float(i), float(i)) for i in range(4)], "row_id long, x double, y double")
    data = admit(tiny, ["x"], "y")
    r2 = regression_scorers()["r2"]
    with pytest.raises(WorkflowError) as error:
        cross_validate(Pipeline().set_estimator("m", LinearRegression()), data, KFold(4), [r2])
    assert error.value.context == (("fold", 0), ("stage", "r2"))
    cv = cross_validate(Pipeline().set_estimator("m", LinearRegression()), data, KFold(4), [r2], failure_policy=RECORD)
    assert [f.failures[0].phase for f in cv.folds] == ["scoring"] * 4 and cv.successful == 0
    broken = Pipeline().add("v", VarianceThreshold(1e9)).set_estimator("m", LinearRegression())
    assert cross_validate(broken, data, KFold(2), [MSE], failure_policy=RECORD).folds[0].failures[0].phase == "fitting"
    weighted = admit(tiny.withColumn("w", (F.col("row_id") > 1).cast("double")), ["x"], "y", weight="w")
    cv = cross_validate(Pipeline().set_estimator("m", LinearRegression()), weighted, KFold(2), [MSE], failure_policy=RECORD)
    assert cv.folds[0].failures[0].phase == "materialization"
    for scorers in ([], [MSE, MSE]):
        with pytest.raises(ValidationError):
            cross_validate(pipe(), data, KFold(2), scorers)


def test_binary_cross_validation(frame):
    d = admit(frame, ["a", "b"], "label", CLASSIFICATION, finiteness=ALLOW_NAN)
    s = binary_scorers()
    cv = cross_validate(pipe(LogisticRegression(c=0.5)), d, KFold(2), [s["accuracy"], s["roc_auc"], s["neg_log_loss"]], 1)
    assert cv.successful == 2 and min(cv.scores("roc_auc")) > 0.9
    with pytest.raises(CompatibilityError):
        cross_validate(pipe(LogisticRegression()), d, KFold(2), [binary_scorers(9)["roc_auc"]], 1)


def test_grid_and_ranks():
    assert grid([("a", [100, 0]), ("b", [False, True])]) == [{"a": 100, "b": False}, {"a": 100, "b": True}, {"a": 0, "b": False}, {"a": 0, "b": True}]
    assert grid([]) == [{}]
    assert competition_ranks([1.0, 3.0, 3.0, None]) == [3, 1, 1, None]
    for bad in ([("a", [])], [("a", [1]), ("a", [2])], [("a", [None])]):
        with pytest.raises(ValidationError):
            grid(bad)


def test_search_and_fusion_agree(data):
    alphas = (0.0, 1.0, 100.0)
    plain = search(lambda p: pipe(RidgeRegression(p["alpha"])), [("alpha", alphas)], data, KFold(3), [MSE], MSE.name, 5)
    fused = ridge_grid(data, KFold(3).assign(data), alphas)
    assert plain.best == fused.best and [c.rank for c in plain.candidates] == list(fused.ranks)
    for c, s in zip(plain.candidates, fused.scores, strict=True):
        assert c.report.scores(MSE.name) == pytest.approx(s, rel=1e-9)
    terminal = plain.model.estimator[1]
    assert terminal.coefficients == pytest.approx(fused.coefficients, rel=1e-9)
    assert terminal.intercept == pytest.approx(fused.intercept, rel=1e-9)
    with pytest.raises(ValidationError):
        search(lambda p: pipe(), [], data, KFold(3), [MSE], "other")


def test_search_records_build_errors(data):
    def build(p):
        return pipe(RidgeRegression(p["alpha"]))
    found = search(build, [("alpha", (-1.0, 1.0))], data, KFold(2), [MSE], MSE.name)
    assert found.candidates[0].error and found.candidates[0].rank is None and found.best == 1


# -- execution -------------------------------------------------------------------------------------
def test_pool_keeps_order_and_lowest_failure():
    assert BoundedPool(4, 1).map(lambda i, x: x * 2, [1, 2, 3]) == [2, 4, 6] == Sequential().map(lambda i, x: x * 2, [1, 2, 3])

    def fail(i, x):
        if i in (1, 3):
            raise ValueError(i)
        return x
    with pytest.raises(ValueError, match="1"):
        BoundedPool(1, 1).map(fail, list(range(5)))
    with pytest.raises(ValueError, match="1"):
        BoundedPool(2, 1).map(fail, list(range(5)))
    running, peak, lock = [0], [0], threading.Lock()

    def count(i, x):
        with lock:
            running[0] += 1
            peak[0] = max(peak[0], running[0])
        threading.Event().wait(0.02)
        with lock:
            running[0] -= 1
    BoundedPool(3, 1).map(count, list(range(12)))
    assert peak[0] <= 3
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValidationError):
            BoundedPool(*bad)


def test_diagnostics():
    d = diagnose(4, None, 2, {"OMP_NUM_THREADS": "2", "MKL_NUM_THREADS": "3", "BLIS_NUM_THREADS": "x"})
    assert [w for w, _ in d.warnings] == ["invalid environment limit", "conflicting environment limits", "workers exceed recommended",
                                          "nested parallelism", "potential oversubscription"]
    assert (d.inner_threads, d.inner_source, d.runnable) == (3, "environment", 12)
    assert diagnose(1, None, 2, {}).warnings == () and diagnose(1 << 40, 1 << 40, 2, {}).runnable == (1 << 62) - 1


# -- artifacts -------------------------------------------------------------------------------------
def test_artifacts(data, frame, tmp_path):
    model = Pipeline().add("impute", SimpleImputer("constant", 1.5)).add("vary", VarianceThreshold(0.1)).add(
        "scale", StandardScaler()).set_estimator("ridge", RidgeRegression(2.0)).fit(data, 3)
    meta = artifact.Metadata(60, -5, True, (("k", "v"),))
    path = str(tmp_path / "m.bin")
    artifact.save(model, path, meta)
    loaded, found = artifact.load(path, "regression")
    assert found == meta and artifact.encode(loaded, meta) == artifact.encode(model, meta)
    a, b = (m.predict(data.df, data.features, data.schema).orderBy("row_id").toPandas() for m in (model, loaded))
    assert a.equals(b)
    d = admit(frame, ["b"], "label", CLASSIFICATION)
    binary = Pipeline().set_estimator("m", LogisticRegression()).fit(d)
    raw = artifact.encode(binary)
    assert artifact.decode(raw, "classification")[0].estimator == binary.estimator
    with pytest.raises(ArtifactError):
        artifact.decode(raw, "regression")


def test_bad_artifacts(data):
    raw = artifact.encode(pipe().fit(data))
    for n in (0, 10, 36, len(raw) - 1):
        with pytest.raises(ArtifactError):
            artifact.decode(raw[:n])
    for at in range(0, len(raw), 7):
        changed = bytearray(raw)
        changed[at] ^= 0x41
        with pytest.raises(ArtifactError):
            artifact.decode(bytes(changed))
    with pytest.raises(ArtifactError):
        artifact.decode(raw + b"x")
    with pytest.raises(ArtifactError):
        artifact.decode(raw, limits=artifact.Limits(max_bytes=100))
    with pytest.raises(ArtifactError):
        artifact.decode(raw, limits=artifact.Limits(max_features=1))
    with pytest.raises(ValidationError):
        artifact.Limits(max_bytes=0)

    class Odd:
        def fit(self, df, columns, schema, weight=None, seed=0):
            return SimpleOdd(schema)

    class SimpleOdd:
        def __init__(self, schema):
            self.schema = self.output_schema = schema

        def transform(self, df, columns, schema, validate=False):
            return df, list(columns)
    custom = Pipeline().add("odd", Odd()).set_estimator("m", LinearRegression()).fit(data.select_features([1]))
    with pytest.raises(ArtifactError):
        artifact.encode(custom)


# -- streams ---------------------------------------------------------------------------------------
def test_stream_predictions(spark, data, tmp_path):
    model = pipe().fit(data)
    source = str(tmp_path / "in")
    data.df.write.parquet(source)
    stream = predict_stream(model, read_features(spark, source, data.df.schema, 1), data.features, data.schema)
    running = (stream.select("row_id", "prediction").writeStream.format("memory").queryName("predicted")
               .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    running.awaitTermination()
    batch = model.predict(data.df, data.features, data.schema).select("row_id", "prediction").toPandas().sort_values("row_id", ignore_index=True)
    assert spark.table("predicted").toPandas().sort_values("row_id", ignore_index=True).equals(batch)


def test_files_of_another_producer(spark):
    """A file written field by field, under other names: y = 2 x + 1 behind a scaler."""
    import hashlib
    import struct
    names = ("other-features-v1", "other-schema-v1")
    text = lambda s: struct.pack(">q", len(s)) + s
    floats = lambda *v: struct.pack(f">q{len(v)}d", len(v), *v)
    digest = hashlib.md5(names[0].encode() + struct.pack(">qB", 1, 1) + text(b"x")).hexdigest()
    schema = struct.pack(">qBq", 1, 1, 1) + text(b"x") + text(f"{names[1]}:{digest}".encode())
    scaler = struct.pack(">BB", 1, 1) + floats(3.0) + floats(4.0) + floats(2.0)
    ols = struct.pack(">B", 1) + floats(4.0) + struct.pack(">d", 7.0) + struct.pack(">BqdBBq", 1, 1, 0.25, 0, 1, 1)
    payload = (text(b"9.9") + text(b"built elsewhere") + struct.pack(">Bq", 1, 30) + struct.pack(">Bq", 1, -7) + struct.pack(">Bq", 2, 1) + text(b"k") + text(b"v")
               + schema + schema + struct.pack(">q", 1) + text(b"scale") + schema + schema + struct.pack(">Bq", 2, 1) + text(scaler)
               + text(b"model") + struct.pack(">Bq", 16, 1) + text(ols))
    raw = b"OTHERS01" + struct.pack(">BBBqB", 1, 0, 1, len(payload), 1) + hashlib.md5(payload).digest() + payload
    form = artifact.Format(b"OTHERS01", names)
    model, meta = artifact.decode(raw, "regression", form=form)
    assert meta == artifact.Metadata(30, -7, True, (("k", "v"),))
    df = spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 10.0)], "row_id long, x double")
    assert [r["prediction"] for r in model.predict(df, ["x"], model.schema).orderBy("row_id").collect()] == [1.0, 7.0, 21.0]
    with pytest.raises(ArtifactError):
        artifact.decode(raw, "regression")
    with pytest.raises(ArtifactError):
        artifact.decode(raw, "regression", form=artifact.Format(b"OTHERS01"))
    again, _ = artifact.decode(artifact.encode(model, meta, form=form), "regression", form=form)
    assert again == model
