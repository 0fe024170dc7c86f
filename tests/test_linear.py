import numpy as np
import pytest

from plumbline.errors import ConvergenceError, ValidationError
from plumbline.operators.linalg import pivoted_solve, qr_r
from plumbline.operators.linear import LinearRegression, LogisticRegression, RidgeRegression
from plumbline.schema import FeatureSchema

# x0 x1 x2 y label w
ROWS = [(-2, .5, 1, -1.15, -3, 1), (-1, -1.5, 0, .4, -3, 2), (0, 2, -.5, -2.25, -3, .5), (1, -.5, 2, 2.6, 7, 3),
        (2, 1.5, 1, 2.85, 7, 1.5), (3, -2, -1, 8.3, -3, .75), (4, .25, .5, 7.175, 7, 2.5), (5, 2.5, -2, 4, 7, 1.25)]
NEW = [(-1.5, 0, .5), (.5, 1, -1), (2.5, -1, 1.5), (6, .75, -.25)]
X = ["x0", "x1", "x2"]
SCHEMA = FeatureSchema.named(X)


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, *map(float, r[:4]), int(r[4]), float(r[5])) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "row_id long, x0 double, x1 double, x2 double, y double, label long, w double").repartition(3)


@pytest.fixture(scope="module")
def new(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(NEW)], "row_id long, x0 double, x1 double, x2 double")


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("row_id").select(*columns).collect()]


def close(a, b):
    assert a == pytest.approx(b, rel=1e-7, abs=1e-7)


def test_ols(train, new):
    m = LinearRegression().fit(train, X, "y", SCHEMA, "w")
    close(m.coefficients, (1.518213709011907, -1.134659131451933, 0.28809732163126911))
    close(m.intercept, 0.68323995217907019)
    assert m.report.rank == 3 and m.report.converged
    close(values(m.predict(new, X, SCHEMA, validate=True), "prediction"),
          [-1.4500319505231558, 0.019590353601821597, 6.0455793386076744, 8.8695035272537446])


def test_ridge(train, new):
    m = RidgeRegression(2.5).fit(train, X, "y", SCHEMA, "w")
    close(m.coefficients, (1.3962161743928965, -0.9502615512897985, 0.2286445303717527))
    close(m.intercept, 0.89091459496454961)
    close(values(m.predict(new, X, SCHEMA), "prediction"),
          [-1.0890874014389187, 0.41011660049944665, 5.6746833777942189, 8.4983543452616406])


def test_logistic(train, new):
    m = LogisticRegression(c=1.7).fit(train, X, "label", SCHEMA, "w")
    close(m.coefficients, (1.1111655620034027, 0.60904238624018381, 1.3883710336561177))
    close(m.intercept, -1.520664994867639)
    assert m.classes == (-3, 7)
    assert values(m.predict(new, X, SCHEMA), "prediction") == [-3, -3, 7, 7]
    close([p for _, p in values(m.predict_proba(new, X, SCHEMA), "p_low", "p_high")],
          [0.076334300707516303, 0.14875353938219263, 0.93881768212099903, 0.9948110291111133])


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_partitions_do_not_matter(train, partitions):
    m = LinearRegression().fit(train.repartition(partitions), X, "y", SCHEMA, "w")
    assert m.coefficients == pytest.approx((1.518213709011907, -1.134659131451933, 0.28809732163126911), rel=1e-10)


def frame(spark, x, y, w=None):
    rows = [(i, *map(float, r), float(t), float(w[i] if w else 1)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    names = [f"x{k}" for k in range(len(x[0]))]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} double" for n in names) + ", y double, w double"), names


def test_small_cases(spark):
    d, n = frame(spark, [(0, 0), (1, 0), (0, 1), (2, -1)], [4, 6, 1, 11])
    m = LinearRegression().fit(d, n, "y", FeatureSchema.named(n))
    assert m.coefficients == pytest.approx((2, -3), abs=1e-10) and m.intercept == pytest.approx(4) and m.report.rank == 2
    d, n = frame(spark, [(0,), (1,), (2,), (100,)], [1, 3, 5, -1000], [1, 2, 3, 0])
    m = LinearRegression().fit(d, n, "y", FeatureSchema.named(n), "w")
    assert (m.coefficients[0], m.intercept) == pytest.approx((2, 1), abs=1e-10)
    d, n = frame(spark, [(1, 2), (2, 4), (3, 6)], [3, 6, 9])
    m = LinearRegression(fit_intercept=False).fit(d, n, "y", FeatureSchema.named(n))
    assert m.report.rank == 1
    assert values(m.predict(d, n, FeatureSchema.named(n)), "prediction") == pytest.approx([3, 6, 9])
    d, n = frame(spark, [(-1,), (0,), (1,)], [-2, 0, 2])
    assert RidgeRegression(2.0).fit(d, n, "y", FeatureSchema.named(n)).coefficients == pytest.approx((1.0,))


def test_logistic_classes_and_failures(spark):
    d, n = frame(spark, [(0,), (1,), (2,)], [0, 1, 2], [1, 1, 0])
    s = FeatureSchema.named(n)
    assert LogisticRegression().fit(d, n, "y", s, "w").classes == (0, 1)
    with pytest.raises(ValidationError):
        LogisticRegression().fit(d, n, "y", s)
    with pytest.raises(ConvergenceError):
        LogisticRegression(c=1e6, tolerance=1e-14, max_iterations=1).fit(d, n, "y", s, "w")
    for bad in ({"c": 0.0}, {"tolerance": 0.0}, {"max_iterations": 0}):
        with pytest.raises(ValidationError):
            LogisticRegression(**bad)
    with pytest.raises(ValidationError):
        RidgeRegression(-1.0)
    with pytest.raises(ValidationError):
        LinearRegression().fit(d.where("y > 5"), n, "y", s)


def test_pivoted_solve_is_stable_over_blocks():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.normal(size=(40, 4))
        a[:, 3] = a[:, 1]
        b = rng.normal(size=40)
        whole = pivoted_solve(a, b)
        r = qr_r(np.vstack([qr_r(np.c_[a, b][:17]), qr_r(np.c_[a, b][17:])]))
        parts = pivoted_solve(r[:, :4], r[:, 4], 40)
        assert whole[1] == parts[1] == 3
        assert np.allclose(whole[0], parts[0], atol=1e-9)
